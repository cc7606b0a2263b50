"""Units with similar interfaces: a set-similarity self-join with prefix filter.

A unit's set holds the (name, type) pairs of its inputs, outputs and in-outs. Units with equal sets are one class, and only classes are compared.
Pairs of all sets stand in one global order, rarest first. Two sets that are similar enough share a pair among the first
``size - needed + 1`` of each, so only those prefixes are join keys, and what many units declare is at the end of that order and seldom in a
prefix. Sizes are banded, places within the sets bound what two can still share, and the overlap of what is left is counted exactly.
Sets stay in rows: none is ever a list. Classes and pairs go by numbers while they are compared, so what is shuffled most holds no texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plcatlas.graph import Graph
from plcatlas.operators.clones import INTERFACE_DIRECTIONS
from plcatlas.session import cut_lineage

PERCENT = 80


def least_overlap(size_a: Column, size_b: Column, percent: int) -> Column:
    """How many pairs two linked sets have in common at least."""
    return F.ceil(percent * (size_a + size_b) / F.lit(100 + percent) - F.lit(1e-9)).cast("bigint")


def classes(items: DataFrame, min_items: int) -> DataFrame:
    """``id, class_id, class_size, size`` of rows ``id, name, type``, each of them once. Classes are told by two hash sums and the size."""
    sums = [F.sum(F.xxhash64(F.lit(seed), "name", "type").cast("decimal(20,0)")).alias(f"sig_{seed}") for seed in (17, 71)]
    sets = items.groupBy("id").agg(*sums, F.count(F.lit(1)).alias("size")).filter(F.col("size") >= min_items)
    key = ["sig_17", "sig_71", "size"]
    found = sets.groupBy(*key).agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return sets.join(found, key).select("id", "class_id", "class_size", "size")


def prefix_pairs(ranked: DataFrame, percent: int) -> DataFrame:
    """Candidates ``a, b`` (the smaller set first) of rows ``class_id, token, size, place``."""
    width = math.log(100 / percent) or 1.0
    head = ranked.filter(F.col("place") <= F.col("size") - F.ceil(percent * F.col("size") / F.lit(100) - F.lit(1e-9)) + 1)
    head = head.withColumn("band", F.floor(F.log(F.col("size").cast("double")) / F.lit(width) + F.lit(1e-9)))
    small = head.select("token", "band", F.col("class_id").alias("a"), F.col("size").alias("size_a"), F.col("place").alias("place_a"))
    # a set is at most one band above any that it is linked with
    large = head.select(
        "token", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"), F.col("class_id").alias("b"), F.col("size").alias("size_b"), F.col("place").alias("place_b")
    )
    met = small.join(large, ["token", "band"]).filter(
        ((F.col("size_a") < F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("a") < F.col("b"))))
        & (100 * F.col("size_a") >= percent * F.col("size_b"))
    )
    rest = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    return met.filter(rest + 1 >= least_overlap(F.col("size_a"), F.col("size_b"), percent)).select("a", "b", "size_a", "size_b").distinct()


def similar_classes(items: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Linked pairs of classes: ``a, b, shared``."""
    number = F.monotonically_increasing_id()
    # written before they are used: a number that is made again may be another one
    numbers = cut_lineage(known.filter("id = class_id").select("class_id", "size", number.alias("no")))
    tokens = items.join(numbers, items["id"] == numbers["class_id"]).select("no", "size", "name", "type")
    common = cut_lineage(tokens.groupBy("name", "type").agg(F.count(F.lit(1)).alias("sets")).select("name", "type", "sets", number.alias("token")))
    rarest_first = Window.partitionBy("class_id").orderBy("sets", "token")
    tokens = tokens.join(common, ["name", "type"]).select(F.col("no").alias("class_id"), "size", "token", "sets")
    ranked = cut_lineage(tokens.select("class_id", "size", "token", F.row_number().over(rarest_first).alias("place")))
    pairs = cut_lineage(prefix_pairs(ranked, percent))
    left = ranked.select(F.col("class_id").alias("a"), "token")
    right = ranked.select(F.col("class_id").alias("b"), "token")
    shared = pairs.join(left, "a").join(right, ["b", "token"]).groupBy("a", "b", "size_a", "size_b").agg(F.count(F.lit(1)).alias("shared"))
    linked = shared.filter(100 * F.col("shared") >= percent * (F.col("size_a") + F.col("size_b") - F.col("shared")))
    name_of = lambda end: numbers.select(F.col("no").alias(end), F.col("class_id").alias(f"class_{end}"))
    named = linked.join(name_of("a"), "a").join(name_of("b"), "b")
    return named.select(F.col("class_a").alias("a"), F.col("class_b").alias("b"), "shared")


def near_clones(graph: Graph, percent: int = PERCENT, min_variables: int = 3) -> DataFrame:
    """One row a unit that has a near clone: its class (the smallest id with its interface), the class's size, and with how many classes and units it is linked.

    Two units are linked if their interfaces have at least ``percent`` of the pairs of both in common (Jaccard); equal ones are.
    """
    items = graph.variables.filter(F.col("direction").isin(*INTERFACE_DIRECTIONS)).select(
        F.col("pou_id").alias("id"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("var_type", F.lit("")).alias("type")
    )
    items = cut_lineage(items.join(graph.pous.select("id"), "id", "left_semi").distinct())
    known = cut_lineage(classes(items, min_variables))
    links = similar_classes(items, known, percent)
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = known.filter("id = class_id").select(F.col("id").alias("b"), "class_size")
    near = both.join(sizes, "b").groupBy(F.col("a").alias("class_id")).agg(F.count(F.lit(1)).alias("near_classes"), F.sum("class_size").alias("near_units"))
    zero = F.lit(0).cast("bigint")
    rows = known.join(near, "class_id", "left").select(
        "id", "class_id", "class_size", "size", F.coalesce("near_classes", zero).alias("near_classes"), (F.col("class_size") - 1 + F.coalesce("near_units", zero)).alias("links"),
    )
    return rows.filter("links > 0").join(graph.pous.select("id", "name", "file_path"), "id")
