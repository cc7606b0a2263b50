"""Jobs that read the corpus view several times have it written once; an older corpus comes out of one reading."""

from conftest import records
from plcatlas.plans import store_queries
from plcatlas.plans.corpus_queries import corpus, stored_corpus
from plcatlas.sources import fixtures


def tables(spark, folder):
    part = [(k, "n", "b", "SMALL", 1 + k % 3, 1.0) for k in range(30)]
    lineitem = [(k, k % 30, 1 + k % 4, 1 + k % 7, float(k % 20), 1.0, 0.0, 0.0, "A", "F", None) for k in range(120)]
    rows = {"part": part, "lineitem": lineitem, "supplier": [(k, "s", 1, 1.0) for k in range(1, 5)], "events": []}
    for name, schema in fixtures.BASE_TABLES.items():
        spark.createDataFrame(rows[name], schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_the_view_is_not_joined_at_every_reading(spark, tmp_path):
    sf = tables(spark, tmp_path)
    files = stored_corpus(spark, sf)
    assert records(files) == records(corpus(spark, sf)) and files.count() == 30
    plan = store_queries.older(files)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Union" not in plan


def test_older_holds_both_versions_of_a_file(spark):
    files = spark.createDataFrame([(f"src/p{k}.st", f"FB_{k}") for k in range(1, 46)], "path string, content string")
    want = [(f"src/p{k}.st", f"FX_{k}" if k % 7 == 0 else f"FB_{k}") for k in range(1, 46) if k % 5]
    want += [(f"aside/p{k}.st", f"FB_{k}") for k in range(9, 46, 9)]
    assert records(store_queries.older(files)) == sorted(want, key=repr)
