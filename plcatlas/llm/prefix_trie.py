"""The trie of conversation prefixes, by vertical bitmaps.

Method: a shard is a bounded range of conversations that begin alike. It is indexed by (position, turn): each entry is the set of the shard's conversations with this turn there,
as a bitset. Depth first, the bitset of a node intersected with the postings of the next position gives its children; a child's popcount is its number of members,
the lowest bit its smallest member, and the members that have no further turn are its list of ends. What shards say of the same
node (told by a SHA-256 over its turns) is then added up.

Scale: conversations are range-sorted and cut into pieces; one of any length stands in blocks of ``BLOCK`` positions, each of which is a member of a shard of its own, under
the node at which the block before ends. A node's sums over its subtree need no walk: each node belongs to its smallest member. A conversation's turns in front of its
first own node count once for each node above them, which gives the saved words; its last turn, if its own and childless, is a leaf of all
its prefixes. Both are sums over a node's members, so a second pass over the same bitmaps makes them.

Turns are told by SHA-256 of role and text. Rows of one turn are ordered by that digest. Defined cases: null role or text is empty; a null turn comes first; rows without
``conv_id`` are left out; repeated rows are turns of their own; an empty table gives an empty result (there is no root without a member); texts and
conversations may be of any length; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plcatlas.llm.common import bounded_batches, map_batches, written
from plcatlas.llm.mixture import word_count
from plcatlas.llm.turns import as_lists, ordered, pieces

BLOCK = 256
SHARD = 1024
SHARD_TURNS = 65_536
FAMILY = 20
HEADS = 4
ROOT = bytes(32)
PIECE = "conv long, part int, seq int, whole boolean, digests array<binary>, words array<long>"
SHARDS = (
    "shard string, start binary, base long, before long, convs array<long>, totals array<long>, digests array<array<binary>>, words array<array<long>>"
)
NODE = "key binary, parent binary, depth long, n long, low long, words long, words_to long, ends array<long>"
SUMS = "key binary, leaves long, saved long"


class Trie(NamedTuple):
    """nodes: key, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens; ends: key, ends (conv ids in order, a row a shard)."""

    nodes: DataFrame
    ends: DataFrame


def packed(b: pa.RecordBatch, offsets: np.ndarray, whole: list[bool], part: int, seq: int) -> pa.RecordBatch:
    n = len(offsets) - 1
    columns = [
        b.column(0).take(pa.array(offsets[:-1])), pa.array([part] * n, pa.int32()), pa.array(range(seq, seq + n), pa.int32()), pa.array(whole),
        as_lists(b.column(1), offsets), as_lists(b.column(2), offsets),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in PIECE.split(", ")])


def sequences(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """Rebuilt conversations as pieces: conv, whole, start (position of the first turn), total (turns), digests, words.

    The first ``crc32(conv) % heads`` turns of a conversation are those of the first of its family, if there is one.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # the length of the role keeps role and text apart
    turn = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), turn, word_count(text).alias("words")).filter("conv is not null")
    sorted_ = ordered(rows, ["conv", F.col("turn").asc_nulls_first(), "digest"]).select("conv", "digest", "words")
    cut = written(pieces(sorted_, packed, PIECE))

    # places of the pieces of split conversations
    place = ["conv", "part", "seq"]
    own = Window.partitionBy("conv")
    slim = cut.filter("not whole").select(*place, F.size("digests").alias("n"))
    slim = slim.withColumns({"offset": F.sum("n").over(own.orderBy("part", "seq")) - F.col("n"), "size": F.sum("n").over(own)}).drop("n")
    split = cut.filter("not whole").join(slim, place)
    whole = cut.filter("whole").withColumns({"offset": F.lit(0).cast("long"), "size": F.size("digests").cast("long")})
    placed = whole.unionByName(split.select(*whole.columns))

    turns = F.arrays_zip("digests", "words")
    first = placed.filter((F.col("conv") % family == 0) & (F.col("offset") < heads - 1))
    first = first.select("conv", F.posexplode(F.slice(turns, 1, heads - 1)).alias("i", "turn"), "offset").filter(F.col("i") + F.col("offset") < heads - 1)
    first = first.groupBy(F.col("conv").alias("family")).agg(F.array_sort(F.collect_list(F.struct((F.col("i") + F.col("offset")).alias("i"), "turn"))).alias("head"))
    taken = (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).cast("int")
    joined = placed.withColumns({"family": F.col("conv") - F.col("conv") % family, "taken": taken}).join(first, "family", "left")
    head = F.transform(F.slice(F.coalesce("head", F.array()), 1, F.col("taken")), lambda x: x["turn"])
    joined = joined.withColumn("head", head).withColumn("cut", F.greatest(F.lit(0).cast("long"), F.least(F.size("digests").cast("long"), F.col("taken") - F.col("offset"))))
    # the turns that the head takes the place of lie in the first pieces
    rest = F.slice(turns, F.col("cut").cast("int") + 1, F.greatest(F.size("digests") - F.col("cut").cast("int"), F.lit(0)))
    seen = F.when(F.col("offset") == 0, F.concat("head", rest)).otherwise(rest)
    joined = joined.withColumns({
        "turns": seen, "total": F.size("head") + F.greatest(F.lit(0).cast("long"), F.col("size") - F.col("taken")),
        "start": F.when(F.col("offset") == 0, F.lit(0).cast("long")).otherwise(F.size("head") + F.greatest(F.lit(0).cast("long"), F.col("offset") - F.col("taken"))),
    })
    return joined.select("conv", "whole", "start", "total", F.transform("turns", lambda x: x["digests"]).alias("digests"), F.transform("turns", lambda x: x["words"]).alias("words"))


def _total(words: Column | str) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda a, x: a + x)


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over the blocks of long conversations in order: the node at which each begins. What goes through is one digest and one sum a block."""
    conv, start, before = None, ROOT, 0
    for b in batches:
        starts, befores = [], []
        for name, local, words in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
            if name != conv:
                conv, start, before = name, ROOT, 0
            starts.append(start)
            befores.append(before)
            start, before = hashlib.sha256(start + local).digest(), before + words
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(starts, pa.binary()), pa.array(befores, pa.int64())], names=["conv", "k", "start", "before"])


def blocks(made: DataFrame, size: int = BLOCK) -> DataFrame:
    """conv, k, start (key of the node in front), before (words in front), total, digests, words: aligned blocks of at most ``size`` turns."""
    short = (F.col("total") <= size) & F.col("whole")
    one = made.filter(short).select("conv", F.lit(0).cast("long").alias("k"), F.lit(ROOT).alias("start"), F.lit(0).cast("long").alias("before"), "total", "digests", "words")
    last = F.greatest(F.col("start"), F.col("start") + F.size("digests") - 1)
    cut = made.filter(~short).withColumn("k", F.explode(F.sequence((F.col("start") / size).cast("long"), (last / size).cast("long"))))
    low = F.greatest(F.col("k") * size, F.col("start"))
    many = F.greatest(F.lit(0).cast("long"), F.least((F.col("k") + 1) * size, F.col("start") + F.size("digests")) - low)
    part = lambda c: F.slice(c, (low - F.col("start") + 1).cast("int"), many.cast("int")).alias(c)
    cut = cut.select("conv", "k", "total", low.alias("low"), part("digests"), part("words")).groupBy("conv", "k", "total").agg(F.array_sort(F.collect_list(F.struct("low", "digests", "words"))).alias("held"))
    flat = lambda c: F.flatten(F.transform("held", lambda x: x[c])).alias(c)
    # an empty piece at the very end of a conversation makes a block of no turns; it says nothing unless it is the only one
    cut = written(cut.select("conv", "k", "total", flat("digests"), flat("words")).filter("size(digests) > 0 or k = 0"))
    local = F.unhex(F.sha2(F.aggregate("digests", F.lit(b""), lambda a, x: F.concat(a, x)), 256))
    slim = cut.select("conv", "k", local.alias("local"), _total("words").alias("sum")).repartition("conv").sortWithinPartitions("conv", "k")
    chain = slim.mapInArrow(chained, "conv long, k long, start binary, before long")
    return one.unionByName(cut.join(chain, ["conv", "k"]).select(*one.columns))


def in_shards(batches: Iterator[pa.RecordBatch], block: int, most: int) -> Iterator[pa.RecordBatch]:
    """Neighbours that begin at the same node, at most ``most`` of them, as one row."""
    part, count, start, held, turns = TaskContext.get().partitionId(), 0, None, [], 0

    def row():
        columns = [[f"{part}.{count}"], [start], [held[0]["k"] * block], [held[0]["before"]], *([[h[c] for h in held]] for c in ("conv", "total", "digests", "words"))]
        longs = pa.list_(pa.int64())
        types = [pa.string(), pa.binary(), pa.int64(), pa.int64(), longs, longs, pa.list_(pa.list_(pa.binary())), pa.list_(longs)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in SHARDS.split(", ")])

    for b in batches:
        for r in b.to_pylist():
            if held and (r["start"] != start or len(held) >= most or turns >= SHARD_TURNS):
                yield row()
                held, turns, count = [], 0, count + 1
            start = r["start"]
            held.append(r)
            turns += len(r["digests"])
    if held:
        yield row()


def lowest(bits: int) -> int:
    return (bits & -bits).bit_length() - 1


def members_of(bits: int) -> list[int]:
    out = []
    while bits:
        out.append(lowest(bits))
        bits &= bits - 1
    return out


def walk(shard: dict) -> Iterator[tuple]:
    """Depth first: key, parent key, depth, members (a bitset), words, words up to here, members that end here (a bitset) of each node of a shard."""
    digests, words, totals, base = shard["digests"], shard["words"], shard["totals"], shard["base"]
    postings: list[dict[bytes, int]] = []
    going = []  # by position, the conversations of the shard that have a turn there
    for i, own in enumerate(digests):
        for place, digest in enumerate(own):
            if place == len(postings):
                postings.append({})
                going.append(0)
            postings[place][digest] = postings[place].get(digest, 0) | 1 << i
            going[place] |= 1 << i
    every = (1 << len(digests)) - 1
    ended = 0
    for i, own in enumerate(digests):
        if totals[i] == base:
            ended |= 1 << i
    if not base:
        yield ROOT, None, 0, every, 0, 0, ended
    stack = [(shard["start"], hashlib.sha256(), 0, every, shard["before"])]
    while stack:
        parent, local, place, bits, words_to = stack.pop()
        if place == len(postings):
            continue
        rest = bits & going[place]
        while rest:
            i = lowest(rest)
            child = bits & postings[place][digests[i][place]]
            rest &= ~child
            inner = local.copy()
            inner.update(digests[i][place])
            key, depth, own = hashlib.sha256(shard["start"] + inner.digest()).digest(), base + place + 1, words[i][place]
            ends = child & ~(going[place + 1] if place + 1 < len(going) else 0)
            # the last position of a block need not be the last of a conversation
            ends = sum(1 << m for m in members_of(ends) if totals[m] == depth) if ends else 0
            yield key, parent, depth, child, own, words_to + own, ends
            stack.append((key, inner, place + 1, child, words_to + own))


def node_rows(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    types = [pa.binary(), pa.binary(), *[pa.int64()] * 5, pa.list_(pa.int64())]
    for shard in b.to_pylist():
        convs, out = shard["convs"], []
        for key, parent, depth, bits, words, words_to, ends in walk(shard):
            out.append((key, parent, depth, bits.bit_count(), convs[lowest(bits)], words, words_to, [convs[i] for i in members_of(ends)] or None))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[x.split()[0] for x in NODE.split(", ")])


def sum_rows(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """What the members of each node add to its leaves and to its saved words."""
    for shard in b.to_pylist():
        known = {c: (kept, leaf) for c, kept, leaf in zip(shard["known"] or [], shard["kept"] or [], shard["leaf"] or [])}
        # a conversation that owns no node shares all its words
        kept = [known[c][0] if c in known else None for c in shard["convs"]]
        leaves = sum(1 << i for i, c in enumerate(shard["convs"]) if c in known and known[c][1])
        shared = [shard["all_words"][i] if x is None else x for i, x in enumerate(kept)]
        out = []
        for key, _, _, bits, words, words_to, _ in walk(shard):
            in_front = words_to - words
            out.append((key, (bits & leaves).bit_count(), sum(max(0, shared[i] - in_front) for i in members_of(bits))))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.binary(), pa.int64(), pa.int64()])], names=["key", "leaves", "saved"])


def prefix_trie(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS, block: int = BLOCK, shard: int = SHARD) -> Trie:
    """All nodes of the trie of the rebuilt conversations."""
    bounded_batches(conversations.sparkSession)
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = blocks(written(sequences(conversations, family, heads)), block)
    sorted_ = made.repartitionByRange(parts, "start", "conv").sortWithinPartitions("start", "conv")
    shards = written(sorted_.select("conv", "k", "start", "before", "total", "digests", "words").mapInArrow(lambda batches: in_shards(batches, block, shard), SHARDS))

    found = written(map_batches(shards, node_rows, NODE))
    ends = found.filter("ends is not null").select("key", "ends")
    nodes = found.groupBy("key").agg(
        F.any_value("parent").alias("parent"), F.any_value("depth").alias("depth"), F.sum("n").alias("n_convs"), F.min("low").alias("conv_id"),
        F.any_value("words").alias("words"), F.any_value("words_to").alias("words_to"),
    )
    nodes = written(nodes)
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))

    # the topmost node of a conversation says how many words lie in front of it, the deepest whether it is a leaf
    owners = nodes.groupBy(F.col("conv_id").alias("conv")).agg(
        F.min_by(F.col("words_to") - F.col("words"), "depth").alias("kept"), (F.max_by("n_children", "depth") == 0).alias("leaf"),
    )
    convs = shards.select("shard", F.explode(F.arrays_zip("convs", F.transform("words", _total).alias("sums"))).alias("x")).select("shard", F.col("x.convs").alias("conv"), F.col("x.sums").alias("sum"))
    own = convs.groupBy("conv").agg(F.sum("sum").alias("all_words"))
    told = convs.select("shard", "conv").join(own, "conv").join(owners, "conv", "left")
    told = told.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("conv", "all_words", "kept", "leaf"))).alias("t"))
    owned = F.filter("t", lambda x: x["leaf"].isNotNull())
    told = told.select(
        "shard", F.transform("t", lambda x: x["all_words"]).alias("all_words"), F.transform(owned, lambda x: x["conv"]).alias("known"),
        F.transform(owned, lambda x: x["kept"]).alias("kept"), F.transform(owned, lambda x: x["leaf"]).alias("leaf"),
    )
    sums = map_batches(shards.join(told, "shard"), sum_rows, SUMS).groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(sums, "key").join(above, "parent", "left")
    return Trie(nodes.select("key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"), ends)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the ids of each key, from lists in order; nothing is kept but the hash."""
    key, digest = None, None
    for b in batches:
        keys, digests = [], []
        for name, ends in zip(b.column(0).to_pylist(), b.column(1)):
            text = ",".join(map(str, ends.as_py())).encode()
            if name == key:
                digest.update(b"," + text)
                continue
            if key is not None:
                keys.append(key)
                digests.append(digest.hexdigest())
            key, digest = name, hashlib.sha256(text)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], names=["key", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])


def with_digests(trie: Trie) -> DataFrame:
    """The nodes with the digest over the ids of the conversations that end there."""
    lists = trie.ends.withColumn("first", F.col("ends")[0]).repartition("key").sortWithinPartitions("key", "first").select("key", "ends")
    hashed = lists.mapInArrow(_hashed, "key binary, ends_sha256 string")
    return trie.nodes.join(hashed, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest()))).drop("key")
