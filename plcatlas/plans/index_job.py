"""The corpus job: from a table of source files to graph tables, fully or for changed files only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plcatlas.graph import Graph
from plcatlas.operators import extract, resolve
from plcatlas.plans.run_log import Journal, record
from plcatlas.schemas import DIAGNOSTICS
from plcatlas.session import cut_lineage
from plcatlas.sources import corpus as sources
from plcatlas.sources.store import GraphStore, diagnostic_rows


@dataclass(frozen=True)
class Options:
    now_ms: int
    resolve_instances: bool = False
    uses: str = "declared"
    tasks: int | None = None


@dataclass(frozen=True)
class Indexed:
    graph: Graph
    rejects: DataFrame


def declarations(corpus: DataFrame, options: Options, facts: DataFrame | None = None) -> Graph:
    """Units, variables, types, fields, globals, files and unresolved references of a corpus.

    The facts are written once and every table is read off them; so are the tables that several others need. All of
    these are narrow next to the texts, which are read twice: here and for their fingerprints.
    """
    if facts is None:
        # branches of CASE blocks are in none of these tables
        facts = cut_lineage(extract.extract(corpus, options.tasks).drop("case_of", "label", "moves"))
    pous = cut_lineage(extract.units(facts, options.now_ms))
    variables = cut_lineage(extract.variables(facts))
    types = cut_lineage(extract.types(facts, options.now_ms))
    refs = cut_lineage(resolve.references(extract.call_sites(facts), pous, variables, options.resolve_instances))
    counts = (
        pous.select(F.col("file_path").alias("path"), F.lit(1).alias("p"), F.lit(0).alias("v"))
        .unionByName(variables.select(F.col("file_path").alias("path"), F.lit(0).alias("p"), F.lit(1).alias("v")))
        .groupBy("path").agg(F.sum("p").alias("pou_count"), F.sum("v").alias("var_count"))
    )
    files = sources.fingerprints(corpus).join(counts, "path", "left").fillna(0, ["pou_count", "var_count"])
    return Graph(
        corpus.sparkSession, pous=pous, variables=variables, types=types, fields=extract.fields(facts),
        variable_lists=extract.global_lists(facts), references=refs,
        files=files.withColumn("last_indexed", F.lit(options.now_ms)),
    )


def edges(
    refs: DataFrame, pous: DataFrame, types: DataFrame, names: DataFrame, options: Options, by: tuple[str, ...] = ()
) -> DataFrame:
    """Edges that start at ``pous``: their resolved references, members and used types."""
    resolved = resolve.resolve(refs, names, by)
    return resolve.unique_edges(
        resolved.unionByName(resolve.contains_edges(pous, by))
        .unionByName(resolve.uses_edges(pous, types, resolved, options.uses, by)), by
    )


def unknown_targets(refs: DataFrame, names: DataFrame) -> DataFrame:
    """Base units and interfaces that nothing declares, as rejects."""
    return resolve.unresolved(refs.filter("type IN ('EXTENDS', 'IMPLEMENTS')"), names).select(
        F.lit("relationship").alias("kind"), "id", F.lit("unknown target").alias("reason")
    )


def build(corpus: DataFrame, options: Options) -> Indexed:
    """The graph of a whole corpus and the rows that found no place in it."""
    declared = declarations(corpus, options)
    names = resolve.name_table(declared.pous, declared.types)
    found = cut_lineage(edges(declared.references, declared.pous, declared.types, names, options))
    graph = declared.with_tables(relationships=found)
    graph, rejects = resolve.validate(graph)
    return Indexed(graph, rejects.unionByName(unknown_targets(declared.references, names)))


def full_index(store: GraphStore, corpus: DataFrame, options: Options, journal: Journal | None = None) -> DataFrame:
    """Index everything anew and return the statistics; with a journal the run writes its events."""
    paths = corpus.select("path")

    def work() -> DataFrame:
        store.overwrite(build(corpus, options).graph)
        return paths

    if journal:
        return record(journal, store, paths, work)
    work()
    return index_stats(store.read(), paths, paths)


def update(
    store: GraphStore, corpus: DataFrame, options: Options, force: bool = False, diagnostics: DataFrame | None = None,
    journal: Journal | None = None,
) -> DataFrame:
    """Bring the store in line with a corpus: index new and changed files, drop those that are gone.

    Returns the statistics; with a journal the run writes its events.
    """
    listing = cut_lineage(sources.fingerprints(corpus))

    def work() -> DataFrame:
        old = store.table("files")
        changed = cut_lineage(sources.changed(listing, old, force).select("path"))
        gone = cut_lineage(sources.stale(old, listing).select("path"))
        apply(store, corpus.join(changed, "path", "left_semi"), changed.unionByName(gone), options, diagnostics)
        return changed

    return record(journal, store, listing, work) if journal else _stats_of(store, listing, work())


def update_named(store: GraphStore, corpus: DataFrame, paths: DataFrame, options: Options) -> DataFrame:
    """Index some files of the corpus, changed or not, and drop those that are gone."""
    named = cut_lineage(paths.select("path").distinct())
    gone = cut_lineage(sources.stale(store.table("files"), corpus).select("path"))
    apply(store, sources.named_files(corpus, named), named.unionByName(gone), options)
    return _stats_of(store, corpus.select("path"), named)


def apply(
    store: GraphStore, corpus: DataFrame, touched: DataFrame, options: Options, diagnostics: DataFrame | None = None
) -> DataFrame:
    """Replace the files of ``touched`` by what ``corpus`` says about them; returns the rejects ``(kind, id, reason)``.

    A changed file can give a name to, or take one from, files that did not change. Every file that refers to a name
    declared in a touched file, before or now, gets its edges anew. Those files come from the store's table of users of
    names, the targets of their references from its table of bearers; nothing else of the store is read. ``diagnostics``
    (positions from 0) take the place of those of the touched files; without them only those of files that are gone go.
    """
    spark = corpus.sparkSession
    touched = cut_lineage(touched.select("path").distinct())
    if touched.isEmpty():
        return spark.createDataFrame([], "kind STRING, id STRING, reason STRING")
    places = touched.select(F.col("path").alias("file_path"))
    new = declarations(corpus, options)
    owners, users = resolve.name_owners(new.pous, new.types), resolve.name_users(new.references)
    name_of = lambda df, column="target_name": df.select(F.col(column).alias("target_name"))
    old_declared = name_of(store.near("pous", places), "name").unionByName(name_of(store.near("types", places), "name"))
    declared = cut_lineage(old_declared.unionByName(name_of(owners)).distinct())
    # names whose rows change in the tables by name
    moved = cut_lineage(
        declared.unionByName(name_of(store.near("references", places))).unionByName(name_of(users)).distinct()
    )
    others = cut_lineage(
        store.near("name_users", declared).select("file_path").distinct().join(places, "file_path", "left_anti")
    )
    refs = cut_lineage(store.near("references", others).unionByName(new.references))
    targets = cut_lineage(name_of(refs).distinct())
    bearers = cut_lineage(
        store.near("name_owners", targets).join(places, "file_path", "left_anti")
        .unionByName(owners.join(targets, "target_name", "left_semi"))
    )
    if options.uses == "file":
        types = store.near("types", others).unionByName(new.types)
    else:
        types = bearers.filter("is_type").withColumnRenamed("target_name", "name")
    names = cut_lineage(resolve.owner_table(bearers))
    fresh = edges(refs, store.near("pous", others).unionByName(new.pous), types, names, options)
    changes = {n: (places, getattr(new, n)) for n in ("pous", "variables", "variable_lists", "types", "fields", "references")}
    changes["relationships"] = (places.unionByName(others), fresh)
    changes["files"] = (touched, new.files)
    changes["name_owners"], changes["name_users"] = (places, owners), (places, users)
    if diagnostics is None:
        gone = touched.join(corpus.select("path"), "path", "left_anti")
        changes["diagnostics"] = (gone, spark.createDataFrame([], DIAGNOSTICS))
    else:
        found = diagnostic_rows(diagnostics.join(places, "file_path", "left_semi"), options.now_ms)
        changes["diagnostics"] = (places, found.dropDuplicates(["id"]))
    store.replace(changes, moved)
    return unknown_targets(refs, names)


def apply_steps(store: GraphStore, corpus: DataFrame, work: DataFrame, options: Options) -> None:
    """:func:`apply` for each step of ``work`` ``(path, step)``, a path in one step only: what all of them change is found in one pass, then they are committed one by one.

    What a step finds is known before the steps are made: what the store holds of a file of the work list holds until the file's
    step, what ``corpus`` says about it from that step on, and all else throughout. So rows meet by step and name, not step by step.
    """
    spark = corpus.sparkSession
    places = cut_lineage(work.select(F.col("path").alias("file_path"), "step").distinct())
    first, last = places.agg(F.min("step"), F.max("step")).first()
    if first is None:
        return
    paths = places.select("file_path")
    new = declarations(corpus, options)
    owners, users = resolve.name_owners(new.pous, new.types), resolve.name_users(new.references)
    at_step = lambda df: df.join(places, "file_path")
    names_of = lambda df, column="target_name": df.select("file_path", F.col(column).alias("target_name"))
    turn = places.withColumnRenamed("step", "_turn")

    def at(keys: DataFrame, on: str, stored: DataFrame, fresh: DataFrame) -> DataFrame:
        """Rows that hold at the steps of ``keys`` ``(on, step)`` once those are made."""
        old = stored.join(turn, "file_path", "left").withColumn("_new", F.lit(False))
        rows = old.unionByName(fresh.join(turn, "file_path").withColumn("_new", F.lit(True))).join(keys, on)
        begun = F.col("_turn") <= F.col("step")
        return rows.filter(F.when(F.col("_new"), begun).otherwise(F.col("_turn").isNull() | ~begun)).drop("_turn", "_new")

    stored_names = names_of(store.near("pous", paths), "name").unionByName(names_of(store.near("types", paths), "name"))
    declared = cut_lineage(at_step(stored_names.unionByName(names_of(owners))).select("target_name", "step").distinct())
    named = declared.select("target_name").distinct()
    concerned = at(declared, "target_name", store.near("name_users", named), users).select("file_path", "step")
    concerned = cut_lineage(concerned.unionByName(places).distinct())
    files = concerned.select("file_path").distinct()
    refs = cut_lineage(at(concerned, "file_path", store.near("references", files), new.references))
    targets = cut_lineage(refs.select("target_name", "step").distinct())
    bearers = cut_lineage(at(targets, "target_name", store.near("name_owners", targets.select("target_name").distinct()), owners))
    pous = at(concerned, "file_path", store.near("pous", files), new.pous)
    if options.uses == "file":
        types = at(concerned, "file_path", store.near("types", files), new.types)
    else:
        types = bearers.filter("is_type").withColumnRenamed("target_name", "name")
    by = ("step",)
    fresh = edges(refs, pous, types, cut_lineage(resolve.owner_table(bearers, by)), options, by)
    changes = {n: (places, at_step(getattr(new, n))) for n in ("pous", "variables", "variable_lists", "types", "fields", "references")}
    changes["relationships"] = (concerned, fresh)
    changes["files"] = (places, new.files.join(places.withColumnRenamed("file_path", "path"), "path"))
    changes["name_owners"], changes["name_users"] = (places, at_step(owners)), (places, at_step(users))
    gone = places.join(corpus.select(F.col("path").alias("file_path")), "file_path", "left_anti")
    changes["diagnostics"] = (gone, None)
    store.replace_in_steps(changes, first, last)


def _stats_of(store: GraphStore, listing: DataFrame, work: DataFrame) -> DataFrame:
    """``index_stats`` of a change; opens the buckets of its files only."""
    mine = {n: store.near(n, work) for n in ("pous", "types", "relationships")}
    return index_stats(Graph(listing.sparkSession, **mine), listing, work)


def index_stats(graph: Graph, listing: DataFrame, work: DataFrame) -> DataFrame:
    """Files seen, indexed and skipped, with the entities and edges of the indexed ones."""
    n = lambda df, key: df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(key).alias("key"), "value")
    mine = work.select(F.col("path").alias("file_path")).distinct()
    rows = (
        n(listing, "total").unionByName(n(mine, "indexed"))
        .unionByName(n(graph.pous.select("file_path").join(mine, "file_path", "left_semi"), "entities"))
        .unionByName(n(graph.types.select("file_path").join(mine, "file_path", "left_semi"), "entities"))
        .unionByName(n(graph.relationships.select("file_path").join(mine, "file_path", "left_semi"), "edges"))
    )
    value = lambda key: F.coalesce(F.sum(F.when(F.col("key") == key, F.col("value"))), F.lit(0))
    return rows.agg(
        value("total").alias("total_files"), value("indexed").alias("indexed_files"),
        (value("total") - value("indexed")).alias("skipped_files"), value("entities").alias("total_entities"),
        value("edges").alias("total_edges"),
    )


def file_stats(graph: Graph) -> DataFrame:
    """Entities and edges per indexed file."""
    part = lambda df, e, r: df.select(
        F.col("file_path").alias("path"), F.lit(e).alias("entities"), F.lit(r).alias("edges")
    )
    counts = (
        part(graph.pous, 1, 0).unionByName(part(graph.types, 1, 0)).unionByName(part(graph.relationships, 0, 1))
        .groupBy("path").agg(F.sum("entities").alias("entities"), F.sum("edges").alias("edges"))
    )
    return graph.files.select("path").join(counts, "path", "left").fillna(0, ["entities", "edges"])


def coverage(facts: DataFrame, corpus: DataFrame) -> DataFrame:
    """Parsed and failed files. A file has failed if it declares nothing or leaves a unit open."""
    # read by three tables; the texts are read once
    facts = cut_lineage(facts.filter(
        "unit_kind IS NOT NULL OR end_kind IS NOT NULL OR heads IS NOT NULL OR type_start OR (section = 'VAR_GLOBAL' AND pou_id IS NULL)"
    ).select("path", "line", "part", "unit_kind", "unit_name", "end_kind", "parent", "pou_id", "heads", "type_start", "section"))
    units = extract.units(facts)
    per_unit = units.select(F.col("file_path").alias("path"), F.col("end_line").isNull().cast("int").alias("open"))
    types = facts.filter("type_start").select("path", F.lit(0).alias("open"))
    lists = facts.filter("section = 'VAR_GLOBAL' AND pou_id IS NULL").select("path", F.lit(0).alias("open"))
    seen = per_unit.unionByName(types).unionByName(lists).groupBy("path").agg(F.max("open").alias("open"))
    status = F.when(F.col("open") == 0, "parsed").otherwise("failed")
    return corpus.select("path").join(seen, "path", "left").select("path", status.alias("status"))


def coverage_summary(rows: DataFrame) -> DataFrame:
    parsed, total = F.count_if(F.col("status") == "parsed"), F.count(F.lit(1))
    return rows.agg(
        total.alias("files"), parsed.alias("parsed"), (total - parsed).alias("failed"),
        F.when(total > 0, F.floor(parsed / total * 1000 + 0.5) / 10).alias("percent"),
    )
