"""Source files as a table ``(path, content)``."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plcatlas.session import cut_lineage

# Path segments that a batch index leaves out if asked to, and files per batch of a stepwise index.
EXCLUDED = ("node_modules", ".git", ".vscode", "dist", "build", "bin", "obj")
FILES_PER_BATCH = 25

_BINARY = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def excluded(path: Column | str, patterns: Sequence[str] = EXCLUDED) -> Column:
    """Whether a whole segment of a path is one of the patterns (``*`` stands for anything within a segment, case is ignored)."""
    value = F.translate(F.col(path) if isinstance(path, str) else path, "\\", "/")
    segments = "|".join(re.escape(p).replace(r"\*", "[^/]*") for p in patterns)
    return value.rlike(f"(?i)(^|/)({segments})(/|$)") if patterns else F.lit(False)


def _texts(raw: DataFrame, root: str, patterns: Sequence[str]) -> DataFrame:
    prefix = root.rstrip("/") + "/"
    path = F.regexp_replace("path", "^file:/+", "/")
    relative = F.when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)
    return (
        raw.filter(~excluded(relative, patterns))
        .select(relative.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    )


def read_corpus(spark: SparkSession, root: str, patterns: Sequence[str] = ()) -> DataFrame:
    """All ``*.st`` files below a folder, paths relative to it; ``patterns`` names path segments to leave out."""
    raw = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.st").load(root)
    )
    return _texts(raw, root, patterns)


def read_files(spark: SparkSession, root: str, paths: DataFrame, patterns: Sequence[str] = ()) -> DataFrame:
    """Some files of a folder, by their paths relative to it; only these are opened. Meant for as many paths as one step takes.

    A file that is no longer there is left out.
    """
    names = [r.path for r in paths.select("path").collect()]
    if not names:
        return spark.createDataFrame([], "path STRING, content STRING")
    # a path is a pattern to the reader
    plain = [f"{root.rstrip('/')}/" + re.sub(r"([\\{}\[\]*?])", r"\\\1", name) for name in names]
    try:
        return _texts(spark.read.format("binaryFile").load(plain), root, patterns)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return named_files(read_corpus(spark, root, patterns), paths)


def stream_corpus(
    spark: SparkSession, root: str, patterns: Sequence[str] = (), files_per_batch: int = FILES_PER_BATCH
) -> DataFrame:
    """The same files as a stream, a bounded number per micro-batch."""
    raw = (
        spark.readStream.format("binaryFile")
        .schema(_BINARY)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.st")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(root)
    )
    return _texts(raw, root, patterns)


def listing_order(path: Column | str) -> Column:
    """Sort key of a listing: relative paths that begin with ``_common`` first, then by path."""
    value = F.col(path) if isinstance(path, str) else path
    return F.struct((~value.startswith("_common")).alias("rest"), value.alias("path"))


def fingerprint(content: Column | str) -> Column:
    return F.sha2(F.col(content) if isinstance(content, str) else content, 256)


def fingerprints(corpus: DataFrame) -> DataFrame:
    return corpus.select("path", fingerprint("content").alias("hash"))


def changed(listing: DataFrame, files: DataFrame, force: bool = False) -> DataFrame:
    """Entries of a listing ``(path, hash)`` that are unknown or differ from the registry."""
    if force:
        return listing
    return listing.join(files.select("path", "hash"), ["path", "hash"], "left_anti")


def changed_files(corpus: DataFrame, files: DataFrame, force: bool = False) -> DataFrame:
    """The part of a corpus that has to be indexed.

    Only paths and hashes are compared, so file texts are not shuffled; the paths that remain are a written table, and
    as long as they are few Spark sends them to the texts and not the other way round.
    """
    if force:
        return corpus
    paths = cut_lineage(changed(fingerprints(corpus), files).select("path"))
    return corpus.join(paths, "path", "left_semi")


def named_files(corpus: DataFrame, paths: DataFrame) -> DataFrame:
    return corpus.join(paths.select("path").distinct(), "path", "left_semi")


def stale(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Registered files that are no longer listed."""
    return files.join(listing.select("path"), "path", "left_anti")
