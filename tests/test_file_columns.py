"""What belongs to a file is made once a file, and the facts of files meet in as many tasks as the caller says."""

from pyspark.sql import functions as F

from plcatlas.operators import extract
from conftest import records

TEXT = "TYPE T{k} : STRUCT\n a : INT;\nEND_STRUCT END_TYPE\nFUNCTION_BLOCK A{k} EXTENDS B\nVAR_INPUT u :\n INT; END_VAR\nB(u);\nEND_FUNCTION_BLOCK\n"


def corpus(spark, files):
    return spark.createDataFrame([(f"f{k}.st", TEXT.replace("{k}", str(k))) for k in range(files)], "path STRING, content STRING")


def test_lines_do_not_carry_the_text_of_their_file(spark):
    cleaned = extract.clean(corpus(spark, 2))
    code = cleaned.select("code")._jdf.queryExecution().analyzed().output().head().toString()
    lines = extract.segments(cleaned).select("path", "line", "part", "text", "has_types", "has_cases", "heads")
    plan = lines._jdf.queryExecution().optimizedPlan().toString().split("\n")
    first = max(k for k, row in enumerate(plan) if "Generate posexplode" in row)
    # nothing above the lines reads the text, which would be once a line
    assert "code#" in code and not any("code#" in row for row in plan[:first])


def test_facts_meet_in_the_tasks_asked_for(spark):
    texts = corpus(spark, 40)
    facts = extract.extract(texts, 16)
    assert facts.rdd.getNumPartitions() == 16
    columns = ("path", "line", "part", "unit_name", "section", "scope", "pou_id")
    assert records(facts, *columns) == records(extract.extract(texts), *columns)
    units = records(extract.units(facts), "id", "start_line", "end_line", "extends")
    assert units == sorted(((f"st:f{k}.st:A{k}", 4, 8, "B") for k in range(40)), key=repr)
    assert facts.filter(F.col("pou_id").isNotNull()).select(F.count_distinct("path")).first()[0] == 40
