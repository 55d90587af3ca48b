"""Secret scan: fixed patterns, then sliding-window entropy over candidate strings.

A candidate is a run of 16 or more key characters with a digit.  Inside it each
character class has its own alphabet, window and threshold; the window slides by
one character and the Shannon entropy follows from incremental counts (one
character enters, one leaves).  Windows over the threshold that also mix kinds
of characters join into one span.  Spans on the allow list (identifiers,
digests named as such, addresses, alphabets, placeholders) and spans that touch
a pattern's span are left out; pattern spans always stay.

Edge cases: a null or empty text has no spans.  Rows are scanned one by one, in
whole, so repeated rows give repeated results and null ids pass through.  Other
columns, whatever their names, are not read.
"""
from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import add_columns

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base32", "entropy_alnum", "entropy_base64")
RANK = {k: i for i, k in enumerate(KINDS)}
#: Any text with a span has this; RE2 reads it in one pass.
MAYBE = r"(?i:password|passwd|secret|token|api_?key)|[A-Za-z0-9+/_=-]{16,}"

#: kind, alphabet, window, least entropy in bits, least digits, least upper, least lower case letters
CLASSES = (
    ("entropy_hex", re.compile(r"[0-9a-f]{24,}|[0-9A-F]{24,}"), 24, 3.0, 4, 0, 0),
    ("entropy_base32", re.compile(r"[A-Z0-9]{16,}"), 16, 3.2, 2, 4, 0),
    ("entropy_alnum", re.compile(r"[a-z0-9]{20,}"), 20, 3.4, 3, 0, 4),
    ("entropy_base64", re.compile(r"[A-Za-z0-9+/_-]{20,}"), 20, 3.7, 2, 2, 2),
)
UUID = re.compile(r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b")
NAMED = re.compile(r"(?i)(sha-?(1|224|256|384|512)|md5|checksum|commit|integrity|digest|etag|data:[a-z]+/[a-z+.-]+;base64)[ :=,\"'-]*$")
ADDRESS = re.compile(r"(?i)(https?|ftp|file)://\S*$")
PLACEHOLDER = re.compile(r"(?i)example|sample|placeholder|dummy|x{6,}|0{8,}|your[_-]?")
ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "0123456789", "qwertyuiopasdfghjklzxcvbnm")

_C_LOG_C = [0.0] + [c * math.log2(c) for c in range(1, 65)]


def entropy_spans(text: str, window: int, bits: float, digits: int, upper: int, lower: int) -> Iterator[tuple[int, int]]:
    """Joined windows of ``text`` that pass, as (start, end)."""
    counts: dict[str, int] = {}
    total, d, u, lo = 0.0, 0, 0, 0        # total: sum of c*log2(c)
    log_n, start, end = math.log2(window), -1, -1
    for i, ch in enumerate(text):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += _C_LOG_C[c + 1] - _C_LOG_C[c]
        d, u, lo = d + ch.isdigit(), u + ch.isupper(), lo + ch.islower()
        if i >= window:
            old = text[i - window]
            c = counts[old]
            counts[old] = c - 1
            total += _C_LOG_C[c - 1] - _C_LOG_C[c]
            d, u, lo = d - old.isdigit(), u - old.isupper(), lo - old.islower()
        if i >= window - 1 and d >= digits and u >= upper and lo >= lower and log_n - total / window >= bits:
            at = i - window + 1
            if start >= 0 and at > end:
                yield start, end
                start = -1
            if start < 0:
                start = at
            end = i + 1
    if start >= 0:
        yield start, end


def allowed(text: str, start: int, end: int, run: int) -> bool:
    """True where the span, in the candidate that starts at ``run``, is on the allow list."""
    found = text[start:end]
    low = found.lower()
    before = text[max(0, run - 200):run]
    if PLACEHOLDER.search(found) or NAMED.search(before) or ADDRESS.search(before):
        return True
    if any(a[i:i + 8] in low for a in ALPHABETS for i in range(len(a) - 7)):
        return True
    near = max(0, start - 40)
    return any(m.start() + near < end and start < m.end() + near for m in UUID.finditer(text[near:end + 40]))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Pattern spans, leftmost and non-overlapping per kind."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], RANK[s[2]]))


def added_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Entropy spans that touch no span of ``base`` or of an earlier class."""
    out: list[tuple[int, int, str]] = []
    for m in CANDIDATE.finditer(text):
        run = m.group()
        if not any(c.isdigit() for c in run):
            continue
        near = [s for s in base if s[0] < m.end() and m.start() < s[1]]
        for kind, alphabet, window, bits, digits, upper, lower in CLASSES:
            for part in alphabet.finditer(run):
                for a, b in entropy_spans(part.group(), window, bits, digits, upper, lower):
                    a, b = a + part.start() + m.start(), b + part.start() + m.start()
                    if not any(s[0] < b and a < s[1] for s in near) and not allowed(text, a, b, m.start()):
                        out.append((a, b, kind))
                        near.append(out[-1])
    return out


def _write(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _scan(texts: pa.Array) -> list[pa.Array]:
    maybe = pc.fill_null(pc.match_substring_regex(texts, MAYBE), False).to_pylist()
    empty = hashlib.sha256(b"").hexdigest()
    n = len(texts)
    counts, sha, spans = [[0] * n for _ in range(4)], [empty] * n, [[] for _ in range(n)]
    for i, hit in enumerate(maybe):
        if not hit:
            continue
        text = texts[i].as_py()
        base = base_spans(text)
        more = added_spans(text, base)
        for s in base:
            counts[RANK[s[2]]][i] += 1
        counts[3][i] = len(more)
        sha[i] = hashlib.sha256(_write(base).encode()).hexdigest()
        spans[i] = [{"kind": k, "start": a, "end": b}
                    for a, b, k in sorted(base + more, key=lambda s: (s[0], RANK[s[2]]))]
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    return [*[pa.array(c, pa.int64()) for c in counts], pa.array(sha, pa.string()), pa.array(spans, pa.list_(span))]


def scan(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default ``doc_id``), counts by kind, the digest of the
    pattern spans and all spans (kind, start, end in code points)."""
    return add_columns(docs, text_col, ["doc_id"] if keep is None else keep, _scan,
                       "n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, "
                       "spans array<struct<kind:string,start:long,end:long>>")


def _redact(texts: pa.Array) -> list[pa.Array]:
    out = []
    maybe = pc.fill_null(pc.match_substring_regex(texts, MAYBE), False).to_pylist()
    for i, hit in enumerate(maybe):
        text = texts[i].as_py()
        if hit:
            base = base_spans(text)
            parts, at = [], 0
            for a, b, kind in sorted(base + added_spans(text, base)):
                if b > at:
                    if a >= at:
                        parts += [text[at:a], f"[{kind.upper()}]"]
                    at = b
            text = "".join(parts) + text[at:]
        out.append(text)
    return [pa.array(out, pa.large_string() if pa.types.is_large_string(texts.type) else pa.string())]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, ``n_chars`` counted anew."""
    from pyspark.sql import functions as F

    from .common import column_name
    new = column_name(docs, "redacted")
    out = add_columns(docs, "text", docs.columns, _redact, f"`{new}` string")
    return out.select(*[F.col(f"`{new}`").alias("text") if c == "text"
                        else F.length(F.col(f"`{new}`")).cast("long").alias(c) if c == "n_chars"
                        else F.col(f"`{c}`") for c in docs.columns])
