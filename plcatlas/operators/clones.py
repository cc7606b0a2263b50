"""Groups of units or types that share a signature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plcatlas.functions.text import definition
from plcatlas.graph import Graph

INTERFACE_DIRECTIONS = ("VAR_INPUT", "VAR_OUTPUT", "VAR_IN_OUT")
CLONE_UNITS = ("FUNCTION_BLOCK", "PROGRAM", "FUNCTION")

_SIGNATURE = ["sig_a", "sig_b", "members"]


def _hash_sums(*columns: str) -> list[Column]:
    """Two independent 64-bit hashes of an item, summed over a multiset: order does not matter, and partial sums add up.

    The sums are decimals and cannot overflow. With the size of the multiset they stand for the sorted list of its
    items, without ever building that list for a unit with very many variables.
    """
    item = [F.col(c) for c in columns]
    return [
        F.sum(F.xxhash64(F.lit(seed), *item).cast("decimal(20,0)")).alias(name)
        for seed, name in ((17, "sig_a"), (71, "sig_b"))
    ]


def _groups(signatures: DataFrame, columns: list[str]) -> DataFrame:
    """One row per member of a group of at least two: ``group_id`` (its smallest id) and ``group_size``.

    A group may be large, so it stays in rows; only its size and label come from an aggregate.
    """
    groups = (
        signatures.groupBy(*_SIGNATURE)
        .agg(F.count(F.lit(1)).alias("group_size"), F.min("id").alias("group_id"))
        .filter("group_size >= 2")
    )
    return signatures.join(groups, _SIGNATURE).select("group_id", "group_size", *columns, F.col("members").alias("items"))


def pou_clones(graph: Graph, min_variables: int = 3, scope: str = "all") -> DataFrame:
    """Units whose inputs, outputs and in-outs agree in name and type."""
    if scope == "type":
        return type_clones(graph, min_variables)
    variables = graph.variables.filter(F.col("direction").isin(*INTERFACE_DIRECTIONS))
    signatures = (
        variables.groupBy(F.col("pou_id").alias("id"))
        .agg(*_hash_sums("name", "var_type"), F.count(F.lit(1)).alias("members"))
        .filter(F.col("members") >= min_variables)
    )
    pous = graph.pous
    if scope == "pou":
        pous = pous.filter(F.col("pou_type").isin(*CLONE_UNITS))
    units = pous.select("id", "name", F.col("pou_type").alias("type"), F.col("file_path").alias("file"))
    return _groups(signatures.join(units, "id"), ["id", "name", "type", "file"])


def type_clones(graph: Graph, min_fields: int = 3) -> DataFrame:
    """STRUCT types whose fields agree in name and type. A definition is one value, so it is sorted in place."""
    fields = definition("definition")["fields"]
    tokens = F.array_sort(F.transform(fields, lambda f: F.concat_ws(":", f["name"], f["type"])))
    text = F.array_join(tokens, ";")
    signatures = (
        graph.types.filter("type_kind = 'STRUCT' AND definition IS NOT NULL")
        .select(
            "id", "name", F.lit("STRUCT").alias("type"), F.col("file_path").alias("file"),
            F.sha2(text, 256).alias("sig_a"), F.length(text).alias("sig_b"), F.size(fields).cast("bigint").alias("members"),
        )
        .filter(F.col("members") >= min_fields)
    )
    return _groups(signatures, ["id", "name", "type", "file"])


def signatures_of(graph: Graph, clones: DataFrame) -> DataFrame:
    """Readable signature per group, taken from the variables of the unit that labels it."""
    labels = clones.select(F.col("group_id").alias("pou_id")).distinct()
    members = graph.variables.filter(F.col("direction").isin(*INTERFACE_DIRECTIONS)).join(labels, "pou_id", "left_semi")
    return members.select(F.col("pou_id").alias("group_id"), F.concat_ws(":", "name", "var_type").alias("item"))


def clone_summary(clones: DataFrame) -> DataFrame:
    """Number of groups and of members."""
    per_group = clones.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    return per_group.agg(
        F.count(F.lit(1)).alias("clone_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("duplicated_entities")
    )
