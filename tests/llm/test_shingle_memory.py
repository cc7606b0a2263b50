"""Shingles are made slice by slice, so what a task holds follows the slice and not the batch."""

import tracemalloc

import numpy as np
import pyarrow as pa

from plcatlas.llm import ngram_join


def test_shingles_hold_a_slice_at_a_time(monkeypatch):
    rng = np.random.default_rng(3)
    batch = pa.array([None, "", " \n", "Two words", *(" ".join(rng.choice(["motor", "valve", "pump", "axis", "door", "belt"], 500)) for _ in range(2400))], pa.string())
    tracemalloc.start()
    got = ngram_join.shingle_sets(batch, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [len(x) for x in got[:4]] == [0, 0, 0, 1] and len(got) == len(batch)
    assert peak < 60 << 20
    for most in (3000, 1 << 40):
        monkeypatch.setattr(ngram_join, "SLICE_BYTES", most)
        again = ngram_join.shingle_sets(batch, 4)
        assert len(again) == len(got) and all(np.array_equal(x, y) for x, y in zip(got, again))
    assert ngram_join.shingle_sets(batch.slice(0, 0), 4) == []
