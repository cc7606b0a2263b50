"""A batch of texts is judged slice by slice, so what a task holds follows the slice and not the batch."""

import tracemalloc

import numpy as np
import pyarrow as pa

from plcatlas.llm import language

WORDS = {"en": "the quick brown fox jumps over lazy dogs while rain falls".split(), "de": "der schnelle braune fuchs springt ueber faule hunde im regen".split()}


def texts(count, words, seed):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(WORDS[("en", "de")[k % 2]], words)) for k in range(count)]


def test_judge_holds_a_slice_at_a_time(monkeypatch):
    model = language.fit(texts(20, 40, 1), ["en", "de"] * 10)
    batch = pa.array([None, "", "123", *texts(2400, 500, 2)], pa.string())
    tracemalloc.start()
    got, share = language.judge(batch, model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[:3] == ["und"] * 3 and got[3:] == ["en", "de"] * 1200
    assert peak < 100 << 20
    monkeypatch.setattr(language, "SLICE_BYTES", 5000)
    again, other = language.judge(batch, model)
    assert again == got and np.allclose(share, other)
    assert language.judge(batch.slice(0, 0), model)[0] == []
