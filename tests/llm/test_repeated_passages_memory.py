import tracemalloc

import numpy as np
import pyarrow as pa

from lodestar.llm import repeated_passages


def test_packer_holds_about_what_it_is_allowed(monkeypatch):
    """A task's strings and places stay near FLUSH_BYTES, and all of them come out."""
    most = 8 << 20
    monkeypatch.setattr(repeated_passages, "FLUSH_BYTES", most)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 50_000, 300)) for _ in range(2000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i:i + 50]), pa.array(np.arange(i, i + 50))], names=["text", "doc_id"])
               for i in range(0, len(texts), 50)]
    list(repeated_passages._packed(iter(batches[:1]), 4))            # what is loaded once
    tracemalloc.start()
    for _ in repeated_passages._packed(iter(batches), 16):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * most

    windows = 0
    blocks = (b.select(["block"]) for b in repeated_passages._packed(iter(batches), 4))
    for b in repeated_passages._unpacked(blocks):
        for words, places in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            for doc, where in repeated_passages._PLACE.iter_unpack(places):
                start = where & ((1 << repeated_passages.START_BITS) - 1)
                n = words.count(b" ") + 1
                assert texts[doc].split(" ")[start:start + n] == words.decode().split(" ")
                windows += n - repeated_passages.WINDOW + 1
    assert windows == len(texts) * (300 - repeated_passages.WINDOW + 1)
