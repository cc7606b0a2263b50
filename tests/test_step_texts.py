"""A stepwise pass reads the texts of a corpus a fixed number of times, however many steps it takes."""

from pyspark.sql import functions as F

from plcatlas.plans.index_job import Options
from plcatlas.sources.store import GraphStore
from plcatlas.streaming import ingest


def test_texts_are_read_once_for_all_steps(spark, tmp_path):
    rows = [(f"f{k}.st", f"FUNCTION_BLOCK A{k}\nEND_FUNCTION_BLOCK\n") for k in range(4)]
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    corpus = spark.createDataFrame(rows, "path STRING, content STRING").coalesce(1).withColumn("content", counted.asNondeterministic()("content"))
    store = GraphStore(spark, str(tmp_path / "store"), 2)
    work = ingest.catch_up(store, corpus, Options(1), files_per_step=1)
    assert work.select("step").distinct().count() == 4
    assert sorted(r.name for r in store.read().pous.collect()) == ["A0", "A1", "A2", "A3"]
    # once for the fingerprints, once for the texts; a join may look at both sides once more
    assert seen.value <= 3 * len(rows)
