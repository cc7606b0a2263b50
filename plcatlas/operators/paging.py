"""Result envelopes, keyset pages and bounded lists."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plcatlas.graph import Graph
from plcatlas.session import cut_lineage

DEFAULT_LIMIT = 50
LIST_ROWS = 10_000


@dataclass(frozen=True)
class Envelope:
    rows: DataFrame
    count: int
    total_count: int
    has_more: bool
    limit: int | None


def effective_limit(limit: int | None) -> int | None:
    """0 means all rows, nothing means the default."""
    return None if limit == 0 else (limit or DEFAULT_LIMIT)


def envelope(rows: DataFrame, limit: int | None = None) -> Envelope:
    """A limited result with the count of all rows; the rows stay a DataFrame."""
    cap = effective_limit(limit)
    total = rows.count()
    shown = rows if cap is None else rows.limit(cap)
    return Envelope(shown, total if cap is None else min(total, cap), total, cap is not None and total > cap, cap)


def counted(rows: DataFrame) -> DataFrame:
    """The total of an envelope as a one-row DataFrame, for jobs that stay lazy."""
    return rows.agg(F.count(F.lit(1)).alias("total_count"))


def paged_lists(
    rows: DataFrame,
    keys: list[str],
    lists: dict[str, Column],
    unique: list[str],
    page_rows: int = LIST_ROWS,
    carry: list[str] | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Sorted lists per key, at most ``page_rows`` items of each list in one row.

    Page p of a key holds the entries p * page_rows to (p + 1) * page_rows of each of its sorted lists, so the pages one
    after the other are the whole lists in order, whatever ``page_rows`` is. The places of the entries come from a range
    sort and the sizes of its ranges: a key that holds a large share of the table is neither gathered into one task
    nor cut off. ``unique`` names columns that tell equal entries apart. Entries of ``lists`` that are null for a row are
    left out of that list; ``carry`` names columns that have one value per key. ``counts`` (``*keys, _n``) saves
    counting the rows where that is known. Sizes of whole lists are for the caller to count, see :func:`list_sizes`.
    """
    if counts is None:
        counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    heavy = cut_lineage(counts.filter(F.col("_n") > page_rows).select(*keys))
    if heavy.isEmpty():
        paged = rows.withColumn("page", F.lit(0)).select(*keys, *(carry or ()), "page", *_items(lists))
    else:
        same = reduce(and_, [rows[k].eqNullSafe(heavy[k]) for k in keys])
        light = rows.join(heavy, same, "left_anti").withColumn("page", F.lit(0)).select(*keys, *(carry or ()), "page", *_items(lists))
        paged = light.unionByName(_ranked(rows.join(heavy, same, "left_semi"), keys, lists, unique, page_rows, carry or []))
    return paged.groupBy(*keys, "page").agg(
        *[F.first(c).alias(c) for c in carry or ()],
        *[F.sort_array(F.collect_list(f"_i{k}")).alias(name) for k, name in enumerate(lists)],
    )


def _items(lists: dict[str, Column]) -> list[Column]:
    return [item.alias(f"_i{k}") for k, item in enumerate(lists.values())]


def _ranked(rows: DataFrame, keys: list[str], lists: dict[str, Column], unique: list[str], page_rows: int, carry: list[str]) -> DataFrame:
    """One row per entry with its page: ranks within the ranges of a sort, and in front of them the sizes of earlier ranges."""
    items = [f"_i{k}" for k in range(len(lists))]
    flat = rows.select(*keys, *carry, *[F.col(c).alias(f"_u{k}") for k, c in enumerate(unique)], *_items(lists))
    kinds = F.array(*[F.when(F.col(c).isNotNull(), F.lit(k)) for k, c in enumerate(items)])
    # a row without any entry stays, so that its key does
    flat = flat.withColumn("_list", F.explode(F.when(F.exists(kinds, lambda k: k.isNotNull()), F.array_compact(kinds)).otherwise(F.array(F.lit(-1)))))
    flat = flat.select(*keys, *carry, "_list", *[F.when(F.col("_list") == k, F.col(c)).alias(c) for k, c in enumerate(items)],
                       *[f"_u{k}" for k in range(len(unique))])
    order = [*items, *[f"_u{k}" for k in range(len(unique))]]
    # written, since ranges are drawn from a sample and must be the same for ranks and sizes
    ranges = cut_lineage(flat.repartitionByRange(*keys, "_list", *order).withColumn("_range", F.spark_partition_id()))
    group = [*keys, "_list"]
    sizes = ranges.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).select(
        *[F.col(c).alias(f"_k{k}") for k, c in enumerate(group)], F.col("_range").alias("_r"), "_before")
    placed = ranges.withColumn("_place", F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order)))
    same = [placed[c].eqNullSafe(sizes[f"_k{k}"]) for k, c in enumerate(group)] + [placed["_range"] == sizes["_r"]]
    return placed.join(sizes, reduce(and_, same)).select(
        *keys, *carry, F.floor((F.col("_before") + F.col("_place") - 1) / page_rows).cast("int").alias("page"), *items
    )


def list_sizes(rows: DataFrame, keys: list[str], lists: dict[str, Column]) -> DataFrame:
    """Entries of each list per key, over all its pages."""
    return rows.groupBy(*keys).agg(*[F.count(item).alias(name) for name, item in lists.items()])


def graph_nodes(graph: Graph, kinds: tuple[str, ...] = ("POU", "TYPE")) -> DataFrame:
    """Nodes of the graph in one shape."""
    pous = graph.pous.select(
        F.lit("POU").alias("kind"), "id", "name", F.col("pou_type").alias("type"), F.col("file_path").alias("file"),
        F.col("start_line").alias("line"),
    )
    types = graph.types.select(
        F.lit("TYPE").alias("kind"), "id", "name", F.col("type_kind").alias("type"),
        F.col("file_path").alias("file"), F.col("start_line").alias("line"),
    )
    return pous.unionByName(types).filter(F.col("kind").isin(*kinds))


PAGE_KEY = ("kind", "file", "line", "id")


def graph_page(
    graph: Graph,
    limit: int = 100,
    after: tuple[str, str, int, str] | None = None,
    kinds: tuple[str, ...] = ("POU", "TYPE"),
) -> DataFrame:
    """One page of nodes in ``(kind, file, line, id)`` order, starting behind the key ``after``.

    The next cursor is the key of the last row. A page is found by its key, so page 10,000 costs what page 1 does.
    """
    nodes = graph_nodes(graph, kinds)
    if after is not None:
        kind, file, line, node = after
        nodes = nodes.filter(
            (F.col("kind") > kind)
            | ((F.col("kind") == kind) & (F.col("file") > file))
            | ((F.col("kind") == kind) & (F.col("file") == file) & (F.col("line") > line))
            | ((F.col("kind") == kind) & (F.col("file") == file) & (F.col("line") == line) & (F.col("id") > node))
        )
    return nodes.orderBy(*PAGE_KEY).limit(limit)


def graph_page_edges(graph: Graph, page: DataFrame) -> DataFrame:
    """Edges that leave the nodes of a page. A page holds at most ``limit`` rows, hence the broadcast."""
    keys = page.select(F.col("id").alias("from_id"))
    return graph.relationships.join(F.broadcast(keys), "from_id", "left_semi").select(
        "id", F.col("from_id").alias("source"), F.col("to_id").alias("target"), "type"
    )
