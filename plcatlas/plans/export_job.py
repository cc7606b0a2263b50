"""The export job: render the documents concerned by a change, write those that differ, keep a manifest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plcatlas.functions import text
from plcatlas.graph import Graph
from plcatlas.operators import render
from plcatlas.operators.paging import LIST_ROWS
from plcatlas.session import cut_lineage

MANIFEST = "entity_id STRING, page INT, relpath STRING, hash STRING, exported_at BIGINT"
_WRITTEN = f"{MANIFEST}, written BOOLEAN"
_INPUTS = "kind STRING, a STRING, b STRING, digest DECIMAL(38,0), n BIGINT"
_INDEX = "entity_id STRING, page INT, relpath STRING, body STRING"


def documents(graph: Graph, corpus: DataFrame | None = None, mermaid: bool = True, page_rows: int = LIST_ROWS) -> DataFrame:
    return (
        render.pou_documents(graph, corpus, page_rows)
        .unionByName(render.type_documents(graph, corpus, page_rows))
        .unionByName(render.index_documents(graph, mermaid, page_rows))
    )


def plan(docs: DataFrame, manifest: DataFrame | None, now_ms: int) -> DataFrame:
    """Documents with hash and whether they have to be written; the body of the others is dropped.

    An index is written by every export. A page that keeps its hash keeps its time.
    """
    hashed = docs.withColumn("hash", F.sha2("body", 256))
    if manifest is None:
        return hashed.withColumn("written", F.lit(True)).withColumn("exported_at", F.lit(now_ms).cast("bigint"))
    old = manifest.select("entity_id", "page", F.col("hash").alias("_hash"), F.col("relpath").alias("_path"), F.col("exported_at").alias("_at"))
    is_index = F.col("relpath").startswith("_index")
    same = F.coalesce((F.col("hash") == F.col("_hash")) & (F.col("relpath") == F.col("_path")), F.lit(False))
    rows = hashed.join(old, ["entity_id", "page"], "left").withColumn("written", ~same | is_index)
    return rows.select(
        "entity_id", "page", "relpath", F.when(F.col("written"), F.col("body")).alias("body"), "hash", "written",
        F.when(same, F.col("_at")).otherwise(F.lit(now_ms)).cast("bigint").alias("exported_at"),
    )


def _writer(base: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Writes the documents of a partition and passes on their manifest rows; a repeated task writes the same again."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(base)
        known: set[str] = set()
        for batch in batches:
            for relpath, body in batch.loc[batch["written"], ["relpath", "body"]].itertuples(index=False):
                target = f"{root}/{relpath}"
                folder = target.rsplit("/", 1)[0]
                if folder not in known:
                    files.create_dir(folder, recursive=True)
                    known.add(folder)
                with files.open_output_stream(target) as out:
                    out.write(body.encode("utf-8"))
            yield batch[["entity_id", "page", "relpath", "hash", "exported_at", "written"]]

    return write


def _manifest_runs(spark: SparkSession, base: str) -> DataFrame | None:
    try:
        return spark.read.schema(f"{_WRITTEN}, run BIGINT").parquet(f"{base}/.manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def latest_manifest(spark: SparkSession, base: str) -> tuple[DataFrame | None, int]:
    runs = _manifest_runs(spark, base)
    if runs is None:
        return None, 0
    last = runs.agg(F.max("run")).first()[0]
    if last is None:
        return None, 0
    return runs.filter(F.col("run") == last).drop("run", "written"), last


# ---- what has changed since the last export ----


def _digest(*columns: str) -> Column:
    """A row as a number; names stand beside the values, so a null is not taken for its neighbour."""
    return F.xxhash64(F.to_json(F.struct(*columns))).cast("decimal(20,0)")


def page_inputs(graph: Graph, corpus: DataFrame | None) -> DataFrame:
    """``(kind, a, b, digest, n)``: what pages are made of, by the entities it belongs to.

    A unit or type with its page name, the variables of a unit, the edges between two entities, the text of a file.
    """
    none = F.lit("")
    row = lambda df, kind, a, b, *columns: df.select(
        F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), _digest(*columns).alias("digest")
    )
    pous, types = graph.pous, graph.types
    rows = (
        row(pous, "pou", F.col("id"), text.slugify("name"),
            "id", "name", "pou_type", "file_path", "start_line", "end_line", "extends", "implements")
        .unionByName(row(types, "type", F.col("id"), text.slugify("name"),
                         "id", "name", "type_kind", "file_path", "start_line", "end_line", "definition"))
        .unionByName(row(graph.variables, "variable", F.col("pou_id"), none,
                         "id", "direction", "name", "var_type", "default_value", "start_line"))
        .unionByName(row(graph.relationships, "edge", F.col("from_id"), F.col("to_id"), "id", "type"))
    )
    if corpus is not None:
        rows = rows.unionByName(row(corpus, "file", F.col("path"), none, "path", "content"))
    return rows.groupBy("kind", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b")).agg(
        F.sum("digest").cast("decimal(38,0)").alias("digest"), F.count(F.lit(1)).alias("n")
    )


def totals(inputs: DataFrame) -> DataFrame:
    """One row a kind; equal totals mean that nothing a page shows has changed."""
    key = F.xxhash64("a", F.lit("|"), "b", "digest", "n").cast("decimal(20,0)")
    return inputs.groupBy("kind").agg(F.sum(key).cast("decimal(38,0)").alias("digest"), F.count(F.lit(1)).alias("n"))


def affected_entities(graph: Graph, now: DataFrame, before: DataFrame) -> DataFrame:
    """Ids of units and types whose pages may differ: ``now`` and ``before`` are :func:`page_inputs`.

    A changed unit stands on the pages of its neighbours, and so does every unit that shares its page name.
    """
    old = before.select("kind", "a", "b", F.col("digest").alias("_digest"), F.col("n").alias("_n"))
    same = F.col("digest").eqNullSafe(F.col("_digest")) & F.col("n").eqNullSafe(F.col("_n"))
    changed = cut_lineage(now.join(old, ["kind", "a", "b"], "full").filter(~same).select("kind", "a", "b"))
    of = lambda *kinds: changed.filter(F.col("kind").isin(*kinds))
    ids = lambda df, column: df.select(F.col(column).alias("id"))

    def renamed(table: DataFrame, kind: str) -> DataFrame:
        slugs = of(kind).select(F.col("b").alias("slug")).distinct()
        sharing = table.select("id", text.slugify("name").alias("slug")).join(slugs, "slug", "left_semi")
        return ids(of(kind), "a").unionByName(ids(sharing, "id")).distinct()

    units = cut_lineage(renamed(graph.pous, "pou"))
    ends = graph.relationships.select("from_id", "to_id")
    around = ids(ends.join(units.withColumnRenamed("id", "from_id"), "from_id", "left_semi"), "to_id").unionByName(
        ids(ends.join(units.withColumnRenamed("id", "to_id"), "to_id", "left_semi"), "from_id")
    )
    paths = of("file").select(F.col("a").alias("file_path"))
    inside = graph.pous.select("id", "file_path").unionByName(graph.types.select("id", "file_path")).join(paths, "file_path", "left_semi")
    found = (
        units.unionByName(around).unionByName(renamed(graph.types, "type")).unionByName(ids(inside, "id"))
        .unionByName(ids(of("variable", "edge"), "a")).unionByName(ids(of("edge"), "b"))
    )
    return cut_lineage(found.distinct())


def _remover(base: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Removes the pages of a partition; one that is gone already is no fault."""

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(base)
        for batch in batches:
            for relpath in batch["relpath"]:
                try:
                    files.delete_file(f"{root}/{relpath}")
                except FileNotFoundError:
                    pass
            yield batch

    return remove


def _kept(manifest: DataFrame) -> DataFrame:
    """Manifest rows of pages that stay as they are."""
    pages = manifest.filter(~F.col("relpath").startswith("_index"))
    return pages.select("entity_id", "page", "relpath", F.lit(None).cast("string").alias("body"), "hash", "exported_at",
                        F.lit(False).alias("written"))


def _setting(corpus: DataFrame | None, mermaid: bool, page_rows: int) -> str:
    return f"schema={render.SCHEMA_VERSION} sources={corpus is not None} mermaid={mermaid} rows={page_rows}"


def _state(spark: SparkSession, base: str, run: int, setting: str) -> tuple[DataFrame, DataFrame] | None:
    """Inputs and index of the last export, if it was complete and made with the same settings."""
    try:
        done = spark.read.schema("setting STRING").parquet(f"{base}/.done/run={run}").first()
        inputs = spark.read.schema(_INPUTS).parquet(f"{base}/.inputs/run={run}")
        index = spark.read.schema(_INDEX).parquet(f"{base}/.index/run={run}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return (inputs, index) if done is not None and done.setting == setting else None


def export(
    graph: Graph, corpus: DataFrame | None, base: str, now_ms: int, mode: str = "incremental", mermaid: bool = True,
    page_rows: int = LIST_ROWS,
) -> DataFrame:
    """Write the documents below ``base`` (a URI or an absolute path on shared storage) and return the statistics.

    An incremental export compares what pages are made of with the last export, renders the pages of entities that are
    concerned, and takes the others over; pages of entities that are gone are removed. The index is written each time.
    """
    spark = graph.spark
    manifest, run = latest_manifest(spark, base)
    before = manifest if mode == "incremental" else None
    setting = _setting(corpus, mermaid, page_rows)
    last = _state(spark, base, run, setting) if before is not None else None
    folder = f"run={run + 1}"
    page_inputs(graph, corpus).write.mode("overwrite").parquet(f"{base}/.inputs/{folder}")
    inputs = spark.read.schema(_INPUTS).parquet(f"{base}/.inputs/{folder}")
    # one row a kind
    unchanged = last is not None and set(totals(inputs).collect()) == set(totals(last[0]).collect())
    index = (last[1] if unchanged else render.index_documents(graph, mermaid, page_rows)).select("entity_id", "page", "relpath", "body")
    index.write.mode("overwrite").parquet(f"{base}/.index/{folder}")
    index = spark.read.schema(_INDEX).parquet(f"{base}/.index/{folder}")
    columns = ["entity_id", "page", "relpath", "body", "hash", "exported_at", "written"]
    if unchanged:
        planned = plan(index, manifest, now_ms).select(*columns).unionByName(_kept(manifest))
    elif last is not None:
        only = affected_entities(graph, inputs, last[0])
        fresh = render.pou_documents(graph, corpus, page_rows, only).unionByName(render.type_documents(graph, corpus, page_rows, only))
        rest = manifest.join(only.withColumnRenamed("id", "entity_id"), "entity_id", "left_anti")
        planned = plan(fresh.unionByName(index), manifest, now_ms).select(*columns).unionByName(_kept(rest))
    else:
        pages = render.pou_documents(graph, corpus, page_rows).unionByName(render.type_documents(graph, corpus, page_rows))
        planned = plan(pages.unionByName(index), before, now_ms).select(*columns)
    planned.mapInPandas(_writer(base), _WRITTEN).write.mode("overwrite").parquet(f"{base}/.manifest/{folder}")
    written = spark.read.schema(_WRITTEN).parquet(f"{base}/.manifest/{folder}")
    if manifest is not None and not unchanged:
        stale = manifest.select("relpath").join(written.select("relpath"), "relpath", "left_anti")
        stale.mapInPandas(_remover(base), "relpath STRING").write.format("noop").mode("overwrite").save()
    # the last step: an export that dies before it is followed by one that renders everything
    spark.range(1).select(F.lit(setting).alias("setting")).write.mode("overwrite").parquet(f"{base}/.done/{folder}")
    return export_stats(written)


def export_stats(rows: DataFrame) -> DataFrame:
    """Documents written and skipped, units and types exported, whether the index was written."""
    first = F.col("page") == 0
    unit, type_ = F.col("relpath").startswith("pous/"), F.col("relpath").startswith("types/")
    index = F.col("relpath").startswith("_index")
    written = F.col("written")
    return rows.agg(
        F.count_if(written & unit & first).alias("pous_exported"), F.count_if(written & type_ & first).alias("types_exported"),
        F.count_if(written).alias("files_written"), F.count_if(~written & ~index).alias("files_skipped"),
        (F.count_if(written & index) > 0).alias("index_written"),
    )


def write_snapshot(graph: Graph, path: str) -> None:
    """Nodes and edges as JSON lines."""
    render.snapshot_nodes(graph).write.mode("overwrite").json(f"{path}/nodes")
    render.snapshot_edges(graph).write.mode("overwrite").json(f"{path}/edges")
