"""The graph tables on storage, replaced file by file.

Every table is a parquet folder partitioned by version and by bucket, a hash of the source file's path. A change
writes the buckets of the files it touches into a new version and then, as its last step, one commit row per table and
bucket. Readers take the latest committed version of every bucket: they see all tables of a change or none, and a
job that dies half-way leaves only a version nobody reads.

Besides the graph there are two tables in buckets of names: the bearers of a name and the files that refer to it. A
change opens the buckets of its files and of the names it adds, takes or refers to, however large the store is.

A change of many steps (``replace_in_steps``) doesn't write whole buckets again for each of them: a version of such a change holds
the rows that come, of all buckets in one place, and a list of the files whose older rows go. Its commit names no bucket. ``table`` puts both together, and
``fold`` or the next change of a bucket writes it whole.
"""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plcatlas.graph import TABLE_SCHEMAS, Graph
from plcatlas.operators import resolve
from plcatlas.schemas import NAME_OWNERS, NAME_USERS, conform, struct_of
from plcatlas.session import cut_lineage

BUCKETS = 256
WRITERS = 8  # tables written at the same time
NAME_TABLES = {"name_owners": NAME_OWNERS, "name_users": NAME_USERS}
SCHEMAS = {**TABLE_SCHEMAS, **NAME_TABLES}
_COMMITS = "version BIGINT, table_name STRING, bucket INT"
_STEP = -1  # where the rows of a step are, instead of a bucket
_REPLACED = "table_name STRING, file_path STRING, version BIGINT"


def file_column(table: str) -> str:
    return "path" if table == "files" else "file_path"


def bucket_column(table: str) -> str:
    return "target_name" if table in NAME_TABLES else file_column(table)


class GraphStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def bucket(self, column: Column | str) -> Column:
        value = F.col(column) if isinstance(column, str) else column
        return F.pmod(F.xxhash64(F.coalesce(value, F.lit(""))), F.lit(self.buckets)).cast("int")

    def _exists(self, path: str, schema: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def commits(self) -> DataFrame:
        found = self._exists(f"{self.path}/commits", _COMMITS)
        return found if found is not None else self.spark.createDataFrame([], _COMMITS)

    def version(self) -> int:
        """Latest version that is committed or being written in steps, 0 for an empty store."""
        return self.commits().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def table(self, name: str, only: Iterable[int] | None = None) -> DataFrame:
        """A table as of the latest commit of each bucket, or of some buckets only; others are not opened."""
        ddl = SCHEMAS[name]
        whole, steps = self._committed(name)
        # at most one row per bucket, a fixed number
        wanted = sorted(set(only)) if only is not None else range(self.buckets)
        parts = [f"{whole[b]}/{b}" for b in wanted if b in whole]
        since = {}
        for b in wanted:
            since.setdefault(whole.get(b, 0), []).append(b)
        later = {v: [s for s in steps if s > v] for v in since}
        found = bool(parts) or any(later.values())
        rows = self._exists(f"{self.path}/{name}", f"{ddl}, version BIGINT, bucket INT") if found else None
        if rows is None:
            return self.spark.createDataFrame([], ddl)
        read = F.concat_ws("/", "version", "bucket").isin(parts)
        if any(later.values()):
            every = sorted({s for mine in later.values() for s in mine})
            rows = rows.filter(read | ((F.col("bucket") == _STEP) & F.col("version").isin(every)))
            home = self.bucket(bucket_column(name))
            held = [home.isin(since[v]) & F.col("version").isin(mine) for v, mine in later.items() if mine]
            rows = self._without_replaced(name, rows.filter(reduce(Column.__or__, held, F.col("bucket") != _STEP)), every)
        else:
            rows = rows.filter(read)
        return rows.select(*struct_of(ddl).fieldNames())

    def _committed(self, name: str) -> tuple[dict[int, int], list[int]]:
        """The versions that hold whole buckets of a table, by bucket, and those that hold the changes of a step to it."""
        # at most one row per bucket and step; steps are folded now and then
        rows = self.commits().filter(F.col("table_name") == name).groupBy("bucket").agg(
            F.max("version").alias("v"), F.collect_set(F.when(F.col("bucket").isNull(), F.col("version"))).alias("steps")
        ).collect()
        return {r.bucket: r.v for r in rows if r.bucket is not None}, sorted(s for r in rows for s in r.steps)

    def _without_replaced(self, name: str, rows: DataFrame, steps: list[int]) -> DataFrame:
        """Rows of a table that no later one of some steps has replaced."""
        replaced = self.spark.read.schema(_REPLACED).parquet(f"{self.path}/replaced").filter(
            F.col("version").isin(steps) & (F.col("table_name") == name)
        )
        last = replaced.groupBy(F.col("file_path").alias(file_column(name))).agg(F.max("version").alias("_last"))
        return rows.join(last, file_column(name), "left").filter("_last IS NULL OR version >= _last")

    def read(self) -> Graph:
        return Graph(self.spark, **{name: partial(self.table, name) for name in TABLE_SCHEMAS})

    def buckets_of(self, paths: DataFrame) -> list[int]:
        rows = paths.select(self.bucket(paths.columns[0]).alias("b")).distinct().collect()
        return sorted(r.b for r in rows)

    def near(self, name: str, keys: DataFrame, column: str | None = None) -> DataFrame:
        """Rows of a table whose ``column`` (the one its buckets are made of) is among the keys; opens their buckets only."""
        column = column or bucket_column(name)
        wanted = keys.select(F.col(keys.columns[0]).alias(column)).distinct()
        return self.table(name, self.buckets_of(keys)).join(wanted, column, "left_semi")

    def replace(self, changes: dict[str, tuple[DataFrame, DataFrame]], names: DataFrame | None = None) -> int:
        """Replace rows by file, in several tables at once: ``{table: (paths, rows)}``; returns the new version.

        ``paths`` names the files whose rows go, ``rows`` are the ones that come. They may be read from this store: a
        version is never written to again, so the tables they come from do not change meanwhile. ``names`` are those
        of the rows that go or come in tables by name.
        """
        version = self.version() + 1
        done: list[tuple[int, str, int]] = []
        writes: list[tuple[str, DataFrame]] = []
        for name, (paths, rows) in changes.items():
            column = file_column(name)
            buckets = self.buckets_of(names if name in NAME_TABLES else paths)
            if not buckets:
                continue
            gone = paths.select(F.col(paths.columns[0]).alias(column)).distinct()
            kept = self.table(name, buckets).join(gone, column, "left_anti")
            fresh = kept.unionByName(conform(rows, SCHEMAS[name]))
            writes.append((name, fresh))
            done += [(version, name, b) for b in buckets]
        self._write_all(writes, version)
        self._commit(done)
        return version

    def replace_in_steps(self, changes: dict[str, tuple[DataFrame, DataFrame | None]], first: int, last: int) -> None:
        """Replace rows by file in the steps from ``first`` to ``last``, each a version with a commit of its own: ``{table: (paths, rows)}``.

        ``paths`` ``(path, step)`` names the files whose rows go at a step, ``rows`` (with ``step``) are those that come. What
        all steps change is written first, and only that; the commits follow in order, so a reader sees the tables as they are after one of the steps.
        """
        before = self.version()
        version = (F.col("step") - first + before + 1).cast("bigint").alias("version")
        # the numbers are taken before anything is written under them: what a change that died has left is never read
        self._commit([(before + 1 + last - first, None, None)])
        paths = [df.select(F.lit(name).alias("table_name"), F.col(df.columns[0]).alias("file_path"), version) for name, (df, _) in changes.items()]
        replaced = reduce(DataFrame.unionByName, paths).hint("rebalance", "version")
        writes = [lambda: replaced.write.mode("append").partitionBy("version").parquet(f"{self.path}/replaced")]
        for name, (_, rows) in changes.items():
            if rows is not None:
                writes.append(partial(self._write_steps, name, rows, version))
        with ThreadPoolExecutor(WRITERS) as pool:
            for _ in pool.map(lambda write: write(), writes):
                pass
        for step in range(first, last + 1):
            self._commit([(before + 1 + step - first, name, None) for name in changes])

    def _write_steps(self, name: str, rows: DataFrame, version: Column) -> None:
        columns = struct_of(SCHEMAS[name]).fieldNames()
        rows = conform(rows, f"{SCHEMAS[name]}, step BIGINT").select(*columns, version, F.lit(_STEP).alias("bucket"))
        rows.hint("rebalance", "version").write.mode("append").partitionBy("version", "bucket").parquet(f"{self.path}/{name}")

    def steps_to_fold(self) -> int:
        """How many steps readers have to put together."""
        whole, steps = self._committed("files")
        least = min((whole.get(b, 0) for b in range(self.buckets)), default=0)
        return sum(s > least for s in steps)

    def fold(self) -> int:
        """Write all buckets whole, with the rows they hold; returns the new version."""
        version = self.version() + 1
        self._write_all([(name, self.table(name)) for name in SCHEMAS], version)
        self._commit([(version, name, b) for name in SCHEMAS for b in range(self.buckets)])
        return version

    def overwrite(self, graph: Graph) -> int:
        """Replace all tables."""
        version = self.version() + 1
        owners, users = resolve.name_owners(graph.pous, graph.types), resolve.name_users(graph.references)
        self._write_all([*graph.tables().items(), ("name_owners", owners), ("name_users", users)], version)
        self._commit([(version, name, b) for name in SCHEMAS for b in range(self.buckets)])
        return version

    def _write_all(self, writes: list[tuple[str, DataFrame]], version: int) -> None:
        """Tables do not depend on each other; their jobs share the cluster instead of queueing up."""
        with ThreadPoolExecutor(WRITERS) as pool:
            for _ in pool.map(lambda item: self._write(item[0], item[1], version), writes):
                pass

    def _write(self, name: str, rows: DataFrame, version: int) -> None:
        rows = rows.withColumn("bucket", self.bucket(bucket_column(name)))
        # rows of a bucket go to few files, and adaptive execution splits a bucket that is too large for one
        rows = rows.hint("rebalance", "bucket")
        target = f"{self.path}/{name}/version={version}"
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(target)

    def _commit(self, rows: list[tuple[int, str, int]]) -> None:
        if rows:
            self.spark.createDataFrame(rows, _COMMITS).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")


# ---- table operations ----


def upsert_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """File registry after new entries: the latest entry per path."""
    rest = [c for c in old.columns if c != "path"]
    latest = old.unionByName(new).groupBy("path").agg(F.max_by(F.struct(*rest), "last_indexed").alias("f"))
    return latest.select("path", "f.*")


def registry_totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("total_files"), F.coalesce(F.sum("pou_count"), F.lit(0)).alias("total_pous"))


def upsert_diagnostics(old: DataFrame, new: DataFrame, analysed: DataFrame) -> DataFrame:
    """Diagnostics after some files were analysed: theirs are replaced, also by none; the last write of an id counts."""
    kept = old.join(analysed.select(F.col(analysed.columns[0]).alias("file_path")).distinct(), "file_path", "left_anti")
    rest = [c for c in new.columns if c != "id"]
    latest = new.groupBy("id").agg(F.max_by(F.struct(*rest), "created_at").alias("d")).select("id", "d.*")
    return kept.unionByName(latest)


def diagnostic_rows(raw: DataFrame, now_ms: int) -> DataFrame:
    """Diagnostics from positions counted from 0: ``(file_path, line, column, severity, code, message, source)``."""
    key = F.concat_ws(":", F.lit("st:diag"), "file_path", "line", "column", F.sha2("message", 256))
    return raw.select(
        key.alias("id"), "file_path", (F.col("line") + 1).alias("line"), (F.col("column") + 1).alias("column"), "severity",
        "code", "message", "source", F.lit(now_ms).cast("bigint").alias("created_at"),
    )


def remove_types(graph: Graph, type_ids: DataFrame) -> Graph:
    """Types go with their fields and with every edge that touches them."""
    ids = type_ids.select(F.col(type_ids.columns[0]).alias("id")).distinct()
    start, end = ids.withColumnRenamed("id", "from_id"), ids.withColumnRenamed("id", "to_id")
    return graph.with_tables(
        types=graph.types.join(ids, "id", "left_anti"),
        fields=graph.fields.join(ids.withColumnRenamed("id", "parent_type_id"), "parent_type_id", "left_anti"),
        relationships=graph.relationships.join(start, "from_id", "left_anti").join(end, "to_id", "left_anti"),
    )


def update_pous(pous: DataFrame, updates: DataFrame) -> DataFrame:
    """Rows of ``updates`` take the place of the units with the same id; other units stay."""
    columns = [c for c in pous.columns if c != "id"]
    new = updates.select("id", F.struct(*columns).alias("_new"))
    return pous.join(new, "id", "left").select(
        "id", *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in columns]
    )


def removal_counts(graph: Graph, paths: DataFrame) -> DataFrame:
    """Rows per table that belong to some files."""
    parts = []
    for name in ("pous", "variables", "variable_lists", "types", "fields", "relationships", "files"):
        column = file_column(name)
        gone = paths.select(F.col(paths.columns[0]).alias(column)).distinct()
        rows = graph.tables()[name].join(gone, column, "left_semi")
        parts.append(rows.agg(F.count(F.lit(1)).alias("count")).select(F.lit(name).alias("table_name"), "count"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def reset(graph: Graph, force: bool = False) -> tuple[Graph, DataFrame]:
    """An empty graph and the number of rows per table that were in the old one."""
    if not force:
        raise ValueError("resetting the graph needs force=True")
    counts = None
    for name, rows in graph.tables().items():
        part = rows.agg(F.count(F.lit(1)).alias("count")).select(F.lit(name).alias("table_name"), "count")
        counts = part if counts is None else counts.unionByName(part)
    return Graph(graph.spark), cut_lineage(counts)
