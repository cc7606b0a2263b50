"""A comparison moves the texts of its pairs only, as long as these are few."""

from plcatlas.llm import ngram_join


def test_compare_takes_only_the_texts_of_its_pairs(spark, monkeypatch):
    texts = spark.createDataFrame([(k, f"a b c d e {k // 2}") for k in range(40)], "node long, text string")
    join = ngram_join.Join(texts, None, 4, 85)
    pairs = spark.createDataFrame([(0, 1), (0, 1), (1, 5)], "a long, b long")
    assert sorted(r.node for r in join.wanted(pairs).collect()) == [0, 1, 5]
    found = {(r.a, r.b): r.linked for r in join.compare(pairs).collect()}
    assert found == {(0, 1): True, (1, 5): False}
    monkeypatch.setattr(ngram_join, "FEW", 2)
    assert join.wanted(pairs).count() == 40
    assert {(r.a, r.b): r.linked for r in join.compare(pairs).collect()} == found
