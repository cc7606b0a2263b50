"""Near clones are compared by numbers: the tables that grow with all pairs of a set hold no texts."""

from conftest import records
from pyspark.sql import types as T

from plcatlas.operators import near_clones


def test_sets_are_compared_without_texts(spark, monkeypatch):
    written, cut = [], near_clones.cut_lineage
    monkeypatch.setattr(near_clones, "cut_lineage", lambda rows: (written.append(rows.schema), cut(rows))[1])
    names = {"u1": "abcde", "u2": "abcdef", "u3": "abxyz"}
    items = spark.createDataFrame([(u, n, "INT") for u, of in names.items() for n in of], "id STRING, name STRING, type STRING").coalesce(1)
    known = spark.createDataFrame([(u, u, 1, len(of)) for u, of in names.items()], "id STRING, class_id STRING, class_size BIGINT, size BIGINT").coalesce(1)
    linked = near_clones.similar_classes(items, known, 80)
    assert [tuple(r) for r in linked.collect()] in ([("u1", "u2", 5)], [("u2", "u1", 5)])
    ranked = [s for s in written if "place" in s.names or "size_a" in s.names]
    assert len(ranked) == 2 and not any(isinstance(f.dataType, (T.StringType, T.StructType)) for s in ranked for f in s.fields)
    assert records(near_clones.similar_classes(items, known, 100), "a") == []
