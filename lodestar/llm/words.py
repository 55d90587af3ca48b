"""Words of many texts as arrays: local ids, one 64-bit hash per distinct word."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

MIX = np.uint64(0x9E3779B97F4A7C15)
ODD = np.uint64(0xD6E8FEB86659FD93)


class Vocabulary(dict):
    """Word to local id; a new word gets the next id and its hash."""

    def __init__(self):
        super().__init__()
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return i

    def hash_array(self) -> np.ndarray:
        return np.array(self.hashes, np.uint64)


_KNOWN = [Vocabulary()]
KNOWN_WORDS = 300_000


def vocabulary() -> Vocabulary:
    """This worker's vocabulary; a new one when it has grown large."""
    if len(_KNOWN[0].hashes) > KNOWN_WORDS:
        _KNOWN[0] = Vocabulary()
    return _KNOWN[0]


def split_words(texts, lower: bool = False) -> list[list[bytes]]:
    """Words of each text of an Arrow array (ASCII white space separates them);
    null has none.  ``bytes.lower`` changes A-Z alone."""
    raw = (t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts)
    return [(t.lower() if lower else t).split() for t in raw]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[list[bytes]]) -> list[np.ndarray]:
    """Hashes of the words of each text."""
    known = vocabulary()
    local = [np.fromiter(map(known.__getitem__, ws), np.int64, len(ws)) for ws in words]
    table = known.hash_array()
    return [table[i] for i in local]


_BYTES = np.arange(256)
IN_WORD = ~(((_BYTES >= 9) & (_BYTES <= 13)) | (_BYTES == 32))
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
LONG_WORD = 64                 # bytes; longer words are hashed one by one


def hashes_of_words(texts, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, number of words of each text) of an Arrow string
    array; null has none.  Eight bytes of all words are mixed in at a time, no word
    becomes a Python object.  Other hashes than those of ``word_hashes``."""
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    size = int(offsets[-1] - offsets[0])
    if not size:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    data = np.zeros(size + 8, np.uint8)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    data[:size] = LOWER[raw] if lower else raw
    edge = offsets[1:-1] - offsets[0]
    inside = IN_WORD[raw]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    cut = edge[(edge > 0) & (edge < size)]                # words end with their text
    opens[cut] = inside[cut]
    closes[cut - 1] = inside[cut - 1]
    at, stop = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    length = stop - at
    out = length.astype(np.uint64) * MIX
    eight = np.ndarray((size + 1,), "<u8", data, strides=(1,))
    todo = np.flatnonzero(length <= LONG_WORD)
    for k in range(0, LONG_WORD, 8):
        todo = todo[length[todo] > k]
        if not len(todo):
            break
        part = eight[at[todo] + k] & LOW_BYTES[np.minimum(length[todo] - k, 8)]
        out[todo] = mixed(out[todo] * ODD + part + MIX)
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        out[i] = xxhash.xxh64_intdigest(data[at[i]:stop[i]])
    return out, np.diff(np.searchsorted(at, offsets - offsets[0]))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each position on (none for the last n - 1)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * ODD + hashes[k:k + m] + MIX
    return mixed(out)


def text_sizes(texts) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
