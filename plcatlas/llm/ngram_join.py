"""N-gram Jaccard self-join, as classes of linked documents.

Method: the Jaccard distance is a metric. Documents meet in cells; in each cell a pivot is chosen, documents go to the region of their nearest
pivot and are compared with it; the triangle inequality then says which others can still be linked: if d(x, p) is known for all x,
only documents whose distances to p differ by at most the radius can be. Cells with more than ``block`` documents that
aren't one class yet are cut into windows of that width (documents near a border are in both), a new pivot is drawn in each, and so on for ``rounds``;
what is left is compared block by block. Every set has a sketch, from which a lower bound of the distance of two sets follows; pairs that it rules out
never have their texts moved. Nothing is sampled or capped.

Two texts that share nothing are at distance 1 from each other and from nearly every pivot, so pivots alone can't part unrelated texts:
every text would be in every region. The first cells therefore come from the sets themselves. A set is split by hash into one part more than
two linked sets can differ in, so linked sets have an equal part; texts of similar size with an equal part share a cell.
(Sizes are banded; a text also shows in the band below if a partner may be there. Empty parts are cells only for the few sets that have so many of them
that no other equal part is certain.) A common passage doesn't make a cell, as a part holds all of a text's shingles of its hash range.

Hot cells: equal sets of a batch are joined before anything is shuffled; a cell with many documents in one batch is shuffled as its pivot, its members
go their own ways.

Defined cases: null, empty and blank texts have no shingles and link with nothing; shorter texts are one shingle; a document without an id
has no number, but its text takes part (``component_id`` is the smallest id of its class, null if there is none); an id, less than 2^62, names one text and
repeated rows of it get equal results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plcatlas.llm.common import bounded_batches, map_batches, written
from plcatlas.llm.components import components
from plcatlas.llm.substring_dedup import runs, sorted_groups
from plcatlas.llm.words import gram_hashes, mix, signed, slices, words_of

SHINGLE = 4
PERCENT = 85
BLOCK = 24
ROUNDS = 1
# Fixed value: up to so many documents to compare, their ids go to the texts, and only their texts are shuffled.
FEW = 1 << 17
UNNUMBERED = 1 << 62
GROWTH = 1.7
SLICE_BYTES = 1 << 20
LONE, PIVOT, MEMBER, SET = 0, 1, 2, 3
PAIR, HOT = 4, 5
ROW = "key long, node long, other long, n int, kind byte, sketch binary"
NAMES = [x.split()[0] for x in ROW.split(", ")]


def most_apart(size: int, percent: int) -> int:
    """How many elements linked sets can differ in, if the smaller has ``size``."""
    return (100 - percent) * size // percent


class Bands:
    """Ranges of set sizes, and the number of parts of each."""

    def __init__(self, percent: int):
        self.percent = percent
        first = 1
        while not most_apart(first, percent) and first < 10_000:
            first += 1
        self.bounds = [first]

    def of(self, size: int) -> int:
        while self.bounds[-1] <= size:
            self.bounds.append(max(self.bounds[-1] + 1, int(self.bounds[-1] * max(GROWTH, 100 / self.percent + 0.01)) + 1))
        return int(np.searchsorted(self.bounds, size, side="right")) - 1

    def parts(self, band: int) -> int:
        apart = most_apart(self.bounds[band + 1] - 1, self.percent)
        return apart + 2 + apart // 50

    def shown_in(self, size: int) -> list[int]:
        """Its own band, and the one below if a linked set may be there. Below the first band only equal sets are linked."""
        band = self.of(size)
        if band < 0:
            return []
        reach = -(-size * self.percent // 100)
        return [band, band - 1] if band > 0 and reach < self.bounds[band] else [band]


def shingle_sets(column, n: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; the words of a slice of the batch are held at a time."""
    out = []
    for part in slices(column, SLICE_BYTES):
        words = words_of(part, lower=True)
        hashes = words.hashes()
        grams = gram_hashes(hashes, n)
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            out.append(np.unique(grams[a : b - n + 1]) if b - a >= n else gram_hashes(hashes[a:b], b - a, 100 + b - a) if b > a else np.zeros(0, np.uint64))
    return out


def cells_of(shingles: np.ndarray, spread: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys of the cells of a set; ``spread`` are its shingles mixed anew."""
    keys, total = [], np.concatenate([[np.uint64(0)], np.cumsum(spread)])
    for band in bands.shown_in(len(shingles)):
        parts = bands.parts(band)
        part = ((shingles >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        content = total[np.append(first[1:], len(part))] - total[first]
        place = part[first]
        missing = parts - len(first)
        if missing and missing >= parts - most_apart(len(shingles), bands.percent):
            empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), place)
            place, content = np.concatenate([place, empty]), np.concatenate([content, np.zeros(len(empty), np.uint64)])
        keys.append(mix(content + place * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(band * 7919 + 1)))
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def as_rows(key, node, other, n, kind, sketches=None) -> pa.RecordBatch:
    columns = (key.astype(np.int64), node, other.astype(np.int64), n.astype(np.int32), kind.astype(np.int8))
    held = pa.nulls(len(node), pa.binary()) if sketches is None else pa.array(sketches, pa.binary())
    return pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), held], names=NAMES)


def cell_rows(b: pa.RecordBatch, n: int, bands: Bands, block: int) -> Iterator[pa.RecordBatch]:
    """A row a document with its set's digest, and rows of its cells; equal sets of the batch show their cells and their sketch once."""
    node = b.column(0).to_numpy(zero_copy_only=False)
    sets = shingle_sets(b.column(1), n)
    digests, cells, owner, seen = [], [], [], {}
    for row, shingles in enumerate(sets):
        spread = mix(shingles + np.uint64(5))
        digest = int(spread.sum()), int(mix(shingles ^ np.uint64(77)).sum()), len(shingles)
        digests.append(digest)
        if len(shingles) and (digest not in seen or node[row] < node[seen[digest]]):
            seen[digest] = row
    sketches = [None] * len(sets)
    for row in seen.values():
        sketches[row] = sketch(sets[row])
        keys = cells_of(sets[row], mix(sets[row] + np.uint64(5)), bands)
        cells.append(keys)
        owner.append(np.full(len(keys), node[row]))
    size = np.array([len(s) for s in sets])
    yield as_rows(np.array([d[0] for d in digests], np.uint64).view(np.int64), node, np.array([d[1] for d in digests], np.uint64).view(np.int64), size, np.full(len(node), SET), sketches)
    if not cells:
        return
    key, own = signed(np.concatenate(cells)), np.concatenate(owner)
    order = np.lexsort((own, key))
    key, own = key[order], own[order]
    first, length = runs(key)
    hot, pivot = np.repeat(length > block, length), np.repeat(own[first], length)
    kind = np.where(hot, np.where(own == pivot, PIVOT, MEMBER), LONE)
    yield as_rows(key, own, np.where(kind == MEMBER, pivot, 0), np.zeros(len(key)), kind)


def met_rows(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of small cells; of large ones, pairs with the pivot, and their members."""
    none = np.zeros(0, np.int64)
    for key, node, other, n, kind, sketches in sorted_groups(batches):
        done = kind == SET
        yield as_rows(key[done], node[done], other[done], n[done], kind[done], sketches[done])
        gone = kind == MEMBER
        pairs_a, pairs_b, hot_key, hot_node = [other[gone]], [node[gone]], [key[gone]], [node[gone]]
        cell = (kind == LONE) | (kind == PIVOT)
        key, node, kind = key[cell], node[cell], kind[cell]
        order = np.lexsort((node, key))
        key, node, kind = key[order], node[order], kind[order]
        first, length = runs(key)
        large = (length > block) | (np.maximum.reduceat(kind, first) == PIVOT if len(first) else none.astype(bool))
        for size in np.unique(length[~large]) if len(length) else []:
            if size > 1:
                grid = node[first[~large & (length == size)][:, None] + np.arange(size)]
                i, j = np.triu_indices(size, 1)
                pairs_a.append(grid[:, i].ravel())
                pairs_b.append(grid[:, j].ravel())
        many = np.repeat(large, length)
        pairs_a.append(np.repeat(node[first], length)[many])
        pairs_b.append(node[many])
        hot_key.append(key[many])
        hot_node.append(node[many])
        a, b = np.concatenate(pairs_a), np.concatenate(pairs_b)
        real = a != b
        a, b = np.minimum(a, b)[real], np.maximum(a, b)[real]
        yield as_rows(a, b, np.zeros(len(a)), np.zeros(len(a)), np.full(len(a), PAIR))
        h, m = np.concatenate(hot_key), np.concatenate(hot_node)
        yield as_rows(h, m, np.zeros(len(h)), np.zeros(len(h)), np.full(len(h), HOT))


class Join:
    """One run of the join: the texts in play and the sketches (node, size, sketch) of all sets."""

    def __init__(self, texts: DataFrame, sketches: DataFrame, n: int, percent: int):
        self.texts, self.sketches, self.n, self.percent = texts, sketches, n, percent

    def wanted(self, pairs: DataFrame) -> DataFrame:
        """The texts of ``pairs``; where these are few, no other text is moved for them."""
        nodes = written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        return self.texts.join(F.broadcast(nodes), "node", "left_semi") if nodes.count() <= FEW else self.texts

    def compare(self, pairs: DataFrame) -> DataFrame:
        """a, b, apart (Jaccard distance), linked, exactly, from both whole texts. Other columns of ``pairs`` are kept by joins of the caller."""
        n, percent = self.n, self.percent

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            # a text that stands in many pairs of the batch is cut into shingles once
            sides = []
            for node, text in ((b.column(0), b.column(2)), (b.column(1), b.column(3))):
                _, first, inverse = np.unique(node.to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
                own = shingle_sets(text.take(pa.array(first)), n)
                sides.append([own[k] for k in inverse])
            left, right = sides
            shared = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right)], np.int64)
            every = np.array([len(x) + len(y) for x, y in zip(left, right)], np.int64) - shared
            return pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(1 - shared / np.maximum(1, every)), pa.array((100 * shared >= percent * every) & (every > 0))],
                names=["a", "b", "apart", "linked"],
            )

        pairs = written(pairs.select("a", "b").distinct())
        texts = self.wanted(pairs)
        left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "text_a", "text_b")
        return written(map_batches(both, run, "a long, b long, apart double, linked boolean"))


def labelled(rows: DataFrame, column: str, comps: DataFrame) -> DataFrame:
    """Adds ``<column>_comp``: the component of a node, itself where it has no link yet."""
    known = comps.select(F.col("node").alias(column), F.col("component").alias("_c"))
    return rows.join(known, column, "left").withColumn(f"{column}_comp", F.coalesce("_c", column)).drop("_c")


def apart_only(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    return labelled(labelled(pairs, "a", comps), "b", comps).filter("a_comp <> b_comp").select("a", "b")


def sketch(shingles: np.ndarray) -> bytes:
    """A byte for each of a power of two of hash ranges: the sum of what the set holds there. Neighbours can be added to get a shorter one."""
    # half as many parts as shingles still tell texts at the limit apart, and a sketch travels once a region
    parts = 1 << max(6, (len(shingles) // 2).bit_length())
    out = np.zeros(parts, np.uint8)
    np.add.at(out, (shingles >> np.uint64(64 - (parts.bit_length() - 1))).astype(np.int64), (mix(shingles + np.uint64(9)) >> np.uint64(56)).astype(np.uint8))
    return out.tobytes()


def may_link(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The rows (a, b, shared) of ``pairs`` that the sketches don't rule out."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sizes = b.column(3).to_numpy(zero_copy_only=False).astype(np.int64) + b.column(4).to_numpy(zero_copy_only=False)
        differ = np.empty(b.num_rows, np.int64)
        for row, (x, y) in enumerate(zip(b.column(5).to_pylist(), b.column(6).to_pylist())):
            least = min(len(x), len(y))
            x, y = (np.frombuffer(z, np.uint8).reshape(least, -1).sum(axis=1, dtype=np.uint8) if len(z) > least else np.frombuffer(z, np.uint8) for z in (x, y))
            differ[row] = np.count_nonzero(x != y)
        return b.filter(pa.array(differ * (100 + percent) <= (100 - percent) * sizes)).select(["a", "b", "shared"])

    for c in "ab":
        pairs = pairs.join(sketches.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("sketch").alias(f"sketch_{c}")).hint("merge"), c)
    return map_batches(pairs.select("a", "b", "shared", "size_a", "size_b", "sketch_a", "sketch_b"), run, "a long, b long, shared long")


def possible_pairs(node: np.ndarray, comp: np.ndarray, size: np.ndarray, side: np.ndarray, sketches: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a block that may be linked: parts that differ are a lower bound of the elements that do."""
    least = min(map(len, sketches))
    table = np.stack([np.frombuffer(x, np.uint8).reshape(least, -1).sum(axis=1, dtype=np.uint8) for x in sketches])
    left, right = [], []
    for k in range(len(node)):
        others = np.flatnonzero((comp != comp[k]) & (node > node[k]) & ((side != side[k]) | (side == 0)))
        if len(others):
            differ = np.maximum((table[others] != table[k]).sum(axis=1), np.abs(size[others] - size[k]))
            others = others[differ * (100 + percent) <= (100 - percent) * (size[others] + size[k])]
            left.append(np.full(len(others), node[k]))
            right.append(node[others])
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def blockwise(join: Join, rows: DataFrame, chunk: int = 512) -> DataFrame:
    """Pairs (a, b) of different components that stand in one region and may be linked. A region of any size is a number of blocks of bounded size;
    a block compares sketches in memory and returns only what they don't rule out."""
    percent = join.percent
    count = F.ceil(F.col("n") / chunk).cast("int")
    placed = rows.withColumn("count", count).withColumn("own", F.pmod(F.xxhash64("node"), F.col("count")).cast("int"))
    # a node's block meets every block of the region once; within its own block side is 0, else it tells the two apart
    placed = placed.select("region", "node", "node_comp", "own", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("with"))
    low, high = F.least("own", "with"), F.greatest("own", "with")
    side = F.when(F.col("own") == F.col("with"), 0).when(F.col("own") < F.col("with"), 1).otherwise(2)
    placed = placed.select(F.xxhash64("region", low, high).alias("key"), "node", F.col("node_comp").alias("comp"), side.alias("side"), "region")
    # a pair may stand in many regions; the smallest of those it shares returns it
    lists = rows.groupBy("node").agg(F.collect_set("region").alias("regions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, comp, side, region, size, sketches, regions in sorted_groups(batches):
            for first, length in zip(*runs(key)):
                at = slice(first, first + length)
                a, b = possible_pairs(node[at], comp[at], size[at], side[at], list(sketches[at]), percent)
                shared = dict(zip(node[at].tolist(), regions[at]))
                here = np.array([np.intersect1d(shared[x], shared[y]).min() == region[first] for x, y in zip(a.tolist(), b.tolist())], dtype=bool)
                a, b = a[here], b[here]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    met = placed.join(join.sketches.join(lists, "node"), "node").select("key", "node", "comp", "side", "region", "size", "sketch", "regions")
    return met.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def with_links(links: DataFrame, comps: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and components after the linked pairs of ``found`` have joined them."""
    new = found.filter("linked").select("a", "b")
    if new.isEmpty():
        return links, comps
    links = links.unionByName(new)
    return links, components(links)


def join_regions(join: Join, regions: DataFrame, links: DataFrame, comps: DataFrame, block: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """Hot cells (region, node): pivots, windows by the triangle inequality, recursion. Returns links and components."""
    radius = 1 - join.percent / 100
    for turn in range(rounds + 1):
        rows = labelled(regions, "node", comps)
        open_ = rows.groupBy("region").agg(
            F.count("*").alias("n"), F.min("node_comp").alias("low"), F.max("node_comp").alias("high"), F.min_by("node", F.xxhash64("node", F.lit(turn))).alias("pivot"),
        ).filter("low < high")
        rows = written(rows.join(open_, "region").select("region", "node", "node_comp", "n", "pivot"))
        if rows.isEmpty():
            break
        # small regions, and after the last round all that are left, are compared in full
        pairs = blockwise(join, rows if turn == rounds else rows.filter(F.col("n") <= block))
        large = rows.filter(F.col("n") > block)
        if turn < rounds:
            pairs = pairs.unionByName(large.filter("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")))
        found = join.compare(pairs)
        links, comps = with_links(links, comps, found)
        if turn == rounds:
            break
        known = large.filter("node <> pivot").withColumns({"a": F.least("node", "pivot"), "b": F.greatest("node", "pivot")}).join(found.select("a", "b", "apart"), ["a", "b"])
        window = F.floor(F.col("apart") / radius)
        regions = written(
            known.select(F.col("region").alias("old"), "node", F.explode(F.array(window, window + 1)).alias("window"))
            .select(F.xxhash64("old", "window", F.lit(turn)).alias("region"), "node")
        )
    return links, comps


def node_of(id_column: str, text_column: str) -> Column:
    """The id; for rows without one a number from 2^62 on that equal texts share."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return F.coalesce(F.col(id_column).cast("long"), F.lit(UNNUMBERED) + F.shiftrightunsigned(F.xxhash64(text), 3))


def near_classes(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", n: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK, rounds: int = ROUNDS,
) -> DataFrame:
    """doc_id, n_shingles, component_id, and node (see ``node_of``) and whether the row stands for its class."""
    bounded_batches(docs.sparkSession)
    bands = Bands(percent)
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(node_of(id_column, text_column).alias("node"), text.alias("text"))

    shown = map_batches(rows, lambda b: cell_rows(b, n, bands, block), ROW)
    route = F.when(F.col("kind") >= MEMBER, F.xxhash64("node")).otherwise(F.col("key"))
    met = shown.repartition(route).sortWithinPartitions("key")
    out = written(met.mapInArrow(lambda batches: met_rows(batches, block), ROW))

    sets = out.filter(F.col("kind") == SET).select("node", "key", "other", "n")
    equal = sets.filter("n > 0").groupBy("key", "other", "n").agg(F.min("node").alias("rep"))
    reps = written(sets.filter("n > 0").distinct().join(equal, ["key", "other", "n"]).select("node", "rep", "n"))

    def by_rep(pairs: DataFrame, *columns: str) -> DataFrame:
        for c in columns:
            known = reps.select(F.col("node").alias(c), F.col("rep").alias("_r"), F.col("n").alias(f"n_{c}"))
            pairs = pairs.join(known, c).drop(c).withColumnRenamed("_r", c)
        return pairs

    pairs = out.filter(F.col("kind") == PAIR).groupBy(F.col("key").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("shared"))
    # sets of too different sizes can't be linked, so neither their texts nor the pair need to travel
    alike = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    pairs = by_rep(pairs, "a", "b").filter("a <> b").filter(alike).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("shared").alias("shared"))
    sketches = written(out.filter("sketch is not null").select("node", F.col("n").alias("size"), "sketch").dropDuplicates(["node"]))
    pairs = written(may_link(pairs, sketches, percent))
    hot = written(by_rep(out.filter(F.col("kind") == HOT).select(F.col("key").alias("region"), "node"), "node").select("region", "node").distinct())
    playing = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(hot.select("node")).distinct()
    # merged at every size: how many documents play isn't bounded, so neither side is ever sent to all tasks
    texts = written(rows.join(playing.hint("merge"), "node").dropDuplicates(["node"]))
    join = Join(texts, sketches, n, percent)

    # every document goes to its nearest pivot first: the smaller document with most parts in common
    nearest = pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a")).select("a", "b")
    found = join.compare(nearest)
    links = found.filter("linked").select("a", "b")
    comps = components(links)
    rest = join.compare(apart_only(pairs.join(nearest, ["a", "b"], "left_anti"), comps))
    links, comps = with_links(links, comps, rest)
    links, comps = join_regions(join, hot, links, comps, block, rounds)

    classed = labelled(reps, "rep", comps).select("node", F.col("rep_comp").alias("component")).distinct()
    number = lambda c: F.when(F.col(c) < UNNUMBERED, F.col(c))
    return sets.join(classed, "node", "left").withColumn("component", F.coalesce("component", "node")).select(
        number("node").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), number("component").alias("component_id"), "node", (F.col("node") == F.col("component")).alias("stays")
    )


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stand for their class of linked texts."""
    stays = near_classes(docs, id_column, text_column, **options).filter("stays").select("node")
    rows = docs.select(node_of(id_column, text_column).alias("node"), F.struct(*docs.columns).alias("row"))
    return rows.join(stays, "node", "left_semi").dropDuplicates(["node"]).select("row.*")
