"""Texts that come out of a small scan are dealt to tasks by their number."""

import __spark_entry__ as entry
import pytest

from plcatlas.sources import fixtures

PARTS = "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE"


@pytest.fixture
def small(spark, tmp_path):
    rows = [(k, f"n{k}", "b", "SMALL", k % 5 + 1, 1.0) for k in range(60)]
    spark.createDataFrame(rows, PARTS).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_texts_get_a_task_for_some_files(spark, small, monkeypatch):
    monkeypatch.setattr(fixtures, "FILES_PER_TASK", 2)
    texts = fixtures.view(spark, small, "plant", part=fixtures.dealt_parts(spark, small))
    assert texts.rdd.getNumPartitions() == 30 and texts.count() == 60
    assert fixtures.spread(spark, small, texts).rdd.getNumPartitions() == 30


@pytest.mark.parametrize("name", ["global_lists", "field_declarations", "states"])
def test_queries_deal_their_texts(spark, small, monkeypatch, name):
    monkeypatch.setattr(fixtures, "FILES_PER_TASK", 2)
    rows = entry.queries()[name](spark, small)
    assert "RepartitionByExpression [p_partkey" in rows._jdf.queryExecution().optimizedPlan().toString()
    assert rows.select("path" if name == "states" else "start_line").count() == {"global_lists": 120, "field_declarations": 240, "states": 180}[name]
