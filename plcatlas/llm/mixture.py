"""Mixing sources to target weights.

Method: each document gets a hash-random key; documents are range-sorted by (source, key), so a hot source is spread over many
partitions; running sums come from sums within each partition plus the sums of the partitions before it; each source is cut at its exact budget, and starts again
from its first document as often as the budget asks for (epochs).

Targets: the total of all sizes is shared by weight; no source gets more than ``most_epochs`` times its size, and what is above that
is reshared by weight among the others until none is above. That level is found from one sorted pass over the sources.

Defined cases: a null text has size 0 and is taken 0 times; null is a source of its own and comes last; a source of size 0 has target 0; rows
of one id, and those without any, are told apart by their text; of rows that agree in id, source and text one may be cut and the other not;
texts of any length are split once; the table may be empty; other columns are ignored, and kept by ``mixed``. The same rows in any order give the same result on every run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plcatlas.llm.common import written

WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
SEED = 20240607
APART = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    # splitting is many times faster than counting matches
    return F.coalesce(F.size(F.array_remove(F.split(text, APART), "")), F.lit(0)).cast("long")


def row_tie(text_column: str) -> Column:
    """Tells rows of one id, or without any, apart: rows that agree in it too are equal in all that the mix looks at."""
    return F.xxhash64(F.coalesce(F.col(text_column).cast("string"), F.lit("")))


def mixed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **options) -> DataFrame:
    """The mix as rows of ``docs``: each document as often as the mix has begun to take it; one that isn't taken goes."""
    takes = mix(docs, id_column, text_column, source_column, **options).filter("taken > 0")
    takes = takes.groupBy("doc_id", "source", "tie").agg(F.max(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias("copies"))
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(source_column).cast("string").alias("source"), row_tie(text_column).alias("tie"), F.struct(*docs.columns).alias("row")
    ).alias("d")
    same = (F.col("d.tie") == F.col("t.tie")) & F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & F.col("d.source").eqNullSafe(F.col("t.source"))
    taken = rows.join(takes.alias("t"), same).select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return taken.select("row.*")


def running(df: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """Adds ``nth`` (from 1) and for each of ``sums`` the sum ``before_<name>`` of all earlier rows: ranges of rows, and the totals of the ranges, of which there are few."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()))
    totals = ranged.groupBy("range").agg(F.count("*").alias("nth"), *[F.sum(c).alias(c) for c in sums])
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("range", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"start_{c}") for c in ("nth", *sums)])
    inside = Window.partitionBy("range").orderBy(*order)
    above = inside.rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumns({"nth": F.row_number().over(inside), **{f"before_{c}": F.coalesce(F.sum(c).over(above), F.lit(0)) for c in sums}})
    placed = own.join(starts, "range")
    return placed.withColumns({"nth": F.col("nth") + F.col("start_nth"), **{f"before_{c}": F.col(f"before_{c}") + F.col(f"start_{c}") for c in sums}}).drop(
        "range", "start_nth", *[f"start_{c}" for c in sums]
    )


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, most_epochs: float = MOST_EPOCHS) -> DataFrame:
    """``source, source_size`` with ``target`` added.

    With targets ``min(cap, level * weight)`` the level is the one at which they add up to the whole. Sources sorted by
    cap / weight reach their caps in that order, so the level follows from running sums. The rows are one a source.
    """
    by_name = F.col("source").asc_nulls_last()
    named = running(sizes.select("source", "source_size"), [by_name], [])
    turn = F.pmod(F.col("nth") - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    step = named.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most_epochs))).withColumn("bend", F.col("cap") / F.col("weight")).drop("nth")
    step = written(running(step, [F.col("bend"), by_name], ["cap", "weight"]))
    whole = step.agg(F.sum("source_size"), F.sum("cap"), F.sum("weight")).first()
    if whole[0] is None:
        return step.select("source", "source_size", F.col("cap").alias("target"))
    budget = min(whole[0] * float(share), whole[1])
    # the level if all sources from this one on are still below their caps; the first source that bears it out decides
    step = step.withColumn("level", (F.lit(float(budget)) - F.col("before_cap")) / (F.lit(float(whole[2])) - F.col("before_weight")))
    level = step.filter("level <= bend").agg(F.min_by("level", "nth")).first()[0]
    target = F.col("cap") if level is None else F.least(F.col("cap"), F.lit(level) * F.col("weight"))
    return step.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
    weights: Sequence[float] = WEIGHTS, share: float = 1.0, most_epochs: float = MOST_EPOCHS, seed: int = SEED,
) -> DataFrame:
    """One row per row: doc_id, size, source, source_size, target, taken (words, repeats counted), and tie (see ``row_tie``)."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), row_tie(text_column).alias("tie"), F.col(source_column).cast("string").alias("source"),
        word_count(F.col(text_column).cast("string")).alias("size"),
    ).withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "tie"))
    # the width of a partition doesn't matter for the result; a source may fill any number of them
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source").asc_nulls_last(), F.col("key"), F.col("doc_id"), F.col("tie")]
    ranged = written(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))

    sums = ranged.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    sizes = sums.groupBy("source").agg(F.sum("part_size").alias("source_size"))
    targets = source_targets(sizes, weights, share, most_epochs)
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("base", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)))
    bases = starts.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select(
        F.col("b.source").alias("source"), "part", "base", "source_size", "target"
    )
    inside = Window.partitionBy("part", "source").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.alias("p").join(bases.alias("s"), (F.col("p.part") == F.col("s.part")) & F.col("p.source").eqNullSafe(F.col("s.source")))
    budget = F.floor(F.col("target") + F.lit(1e-6)).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    last = budget - epochs * F.col("source_size")
    before = F.col("base") + F.col("inside")
    partial = F.greatest(F.lit(0), F.least(F.col("size"), last - before))
    return joined.select(
        "doc_id", "tie", F.col("p.source").alias("source"), "size", "source_size", "target",
        (epochs * F.col("size") + partial).cast("long").alias("taken"),
    )
