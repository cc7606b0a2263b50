"""Texts are encoded slice by slice and few pieces are kept, so what a worker holds follows neither the batch nor the corpus."""

import numpy as np
import public_tokenizers

from plcatlas.llm import bpe

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_a_worker_keeps_few_pieces():
    own = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    letters = np.random.default_rng(5).choice(list("abcdefghij"), (300_000, 7))
    text = " ".join(map("".join, letters))
    own.encode(text)
    assert len(own) + len(own.older) <= 200_000
    assert own.decode(own.encode(text[:5000])) == text[:5000].encode()


def test_slices_of_a_batch_give_the_same_ids(spark, monkeypatch):
    texts = [None, "", "a b", "ünï cödé " * 40, *(f"word{k} and more of it, {k * k}\n" * 9 for k in range(60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING").coalesce(1)
    own = bpe.codec(RANKS, public_tokenizers.PATTERN)
    wanted = {k: np.frombuffer(own.encode(text or ""), "<i4").tolist() for k, text in enumerate(texts)}
    for most in (1, 500, 1 << 20):
        monkeypatch.setattr(bpe, "SLICE_BYTES", most)
        got = {r.doc_id: r.ids for r in bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect()}
        assert got == wanted
