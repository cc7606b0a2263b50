"""Repair of the structure of conversations: the cheapest edits that make roles follow ``(system? (user assistant)+)?``.

Method: a run-length dynamic program. A row is one of nine symbols (its role, and whether it has to go or ends too early). The symbol's transition is a 4 x 4 matrix of
costs in the min-plus algebra between the states of the automaton (nothing yet, after system, after user, after assistant), inserts before the row included. Equal
neighbours are one run; a run of n rows is advanced by the matrices of the powers of two in n, which are kept. From the end backwards this gives the
cost of the rest at every border of a run; forwards the choices are unrolled: the first edit in ASCII order (Delete, Insert, Keep, Rerole) that stays on
a cheapest path. State and letter determine the edit, so the audit alone says what was done.

Scale: rows are range-sorted, a conversation may fill any number of pieces of bounded size (``turns``). Whole ones are solved where they stand. Of a split one,
every piece gives the product of its matrices; costs run backwards over the pieces, each piece tells in which state it ends for each state it may begin
in, states run forwards, and then all pieces are unrolled at the same time. Rows seen in an earlier piece are found by their digests. Only the
digest over all repaired text of a split conversation has to be made in order: one task streams over its pieces and keeps nothing but the hash.

Rows of one turn are ordered by role and a hash of the text. Duplicates are told by SHA-256 of role and text. Defined cases: null role, text, conv_id or turn count as one
space in the key of the damage, null roles and texts as one space in the row; a null turn comes first; null ``conv_id`` is a conversation of its own; repeated rows
are duplicates, so all but one go; a role other than system, user, assistant by its first letter can only be reroled or deleted; texts and conversations may be of
any length; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plcatlas.llm.common import map_batches, written
from plcatlas.llm.turns import as_lists, ordered, pieces

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
NEVER = 1 << 60
REROLE, DELETE, INSERT, CUT_SHORT = 3, 4, 3, 3
ROLES = ("s", "u", "a")
# From which states a row or insert of a role may come next, and the two that may stand last.
AFTER_KEEP = {0: {START: SYSTEM}, 1: {START: USER, SYSTEM: USER, ASSISTANT: USER}, 2: {USER: ASSISTANT}}
NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
LAST = (START, ASSISTANT)
MUST_GO = 0
PLACE = "who string, part int, seq int"
PIECE = (
    "who string, part int, seq int, whole boolean, symbols binary, digests array<binary>, turns array<long>, roles array<string>, "
    "texts array<string>, initials array<string>"
)
REPAIRED = "who string, part int, seq int, whole boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<string>"
MADE = [x.split()[0] for x in REPAIRED.split(", ")]


def symbol(initial: str, truncated: bool) -> int:
    """Of a row that may stay; ``MUST_GO`` is that of one that may not."""
    return 1 + 2 * (ROLES.index(initial) if initial in ROLES else 3) + truncated


def edits(code: int, state: int) -> list[tuple[str, int, int]]:
    """Letter, cost and next state of what can be done to a row, by letter."""
    out = [("D", DELETE, state)]
    if code != MUST_GO:
        role, truncated = divmod(code - 1, 2)
        after = AFTER_KEEP.get(role, {}).get(state)
        if after is not None:
            out.append(("K", truncated * CUT_SHORT, after))
        out.append(("R", REROLE + truncated * CUT_SHORT, NEXT[state]))
    return out


def times(a: tuple, b: tuple) -> tuple:
    """Product of two min-plus matrices."""
    return tuple(tuple(min(NEVER, *(a[i][k] + b[k][j] for k in STATES)) for j in STATES) for i in STATES)


def applied(matrix: tuple, rest: tuple) -> tuple:
    return tuple(min(row[k] + rest[k] for k in STATES) for row in matrix)


UNIT = tuple(tuple(0 if i == j else NEVER for j in STATES) for i in STATES)


def _inserts() -> tuple:
    """Cheapest inserts between two states."""
    one = tuple(tuple(0 if i == j else INSERT if NEXT[i] == j else NEVER for j in STATES) for i in STATES)
    two = times(one, one)
    return times(two, two)


INSERTS = _inserts()
END = tuple(min(INSERTS[i][j] for j in LAST) for i in STATES)


@lru_cache(maxsize=None)
def power(code: int, bit: int) -> tuple:
    """The matrix of a run of ``2 ** bit`` equal symbols."""
    if bit:
        half = power(code, bit - 1)
        return times(half, half)
    row = [[NEVER] * 4 for _ in STATES]
    for i in STATES:
        for _, cost, j in edits(code, i):
            row[i][j] = min(row[i][j], cost)
    return times(INSERTS, tuple(map(tuple, row)))


def collapsed(symbols: bytes) -> list[tuple[int, int]]:
    return [(code, sum(1 for _ in same)) for code, same in groupby(symbols)]


def before_run(code: int, n: int, rest: tuple) -> tuple:
    """Costs of the rest before a run, from those after it."""
    bit = 0
    while n:
        if n & 1:
            rest = applied(power(code, bit), rest)
        n, bit = n >> 1, bit + 1
    return rest


def product(symbols: bytes) -> tuple:
    out = UNIT
    for code, n in collapsed(symbols):
        bit = 0
        while n:
            if n & 1:
                out = times(out, power(code, bit))
            n, bit = n >> 1, bit + 1
    return out


def unroll(symbols: bytes, state: int, rest: tuple, end: bool) -> tuple[str, int]:
    """The edits of a piece from a state, given the costs of what comes after it, and the state it ends in; ``end`` if nothing does."""
    table = collapsed(symbols)
    borders = [rest]
    for code, n in reversed(table):
        borders.append(before_run(code, n, borders[-1]))
    audit = []
    for (code, n), after in zip(table, reversed(borders[:-1])):
        costs = [after]
        for _ in range(n):
            costs.append(applied(power(code, 0), costs[-1]))
        for here, there in zip(reversed(costs[1:]), reversed(costs[:-1])):
            done = False
            while not done:
                options = edits(code, state)
                options.insert(1, ("I", INSERT, NEXT[state]))
                for letter, cost, after_it in options:
                    if here[state] == cost + (here if letter == "I" else there)[after_it]:
                        break
                audit.append(letter)
                state, done = after_it, letter != "I"
    while end and rest[state]:
        audit.append("I")
        state = NEXT[state]
    return "".join(audit), state


def enacted(audit: str, state: int, symbols: bytes, roles: list[str], texts: list[str]) -> tuple[list[str], int]:
    """The repaired rows as ``role:text``, and what the edits cost."""
    out, row, cost = [], 0, 0
    for letter in audit:
        made = "user" if NEXT[state] == USER else "assistant"
        if letter == "I":
            out.append(f"{made}:")
            state, cost = NEXT[state], cost + INSERT
            continue
        step = next(x for x in edits(symbols[row], state) if x[0] == letter)
        if letter != "D":
            out.append(f"{roles[row] if letter == 'K' else made}:{texts[row]}")
        state, cost, row = step[2], cost + step[1], row + 1
    return out, cost


def damaged(conversations: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """who, turn, role, text, kept: rows dropped, emptied, cut, repeated and reroled by the checksum of conversation and turn. Of a dropped row its conversation stays."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(blank(id_column), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = conversations.select(F.col(id_column).cast("string").alias("who"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), hit.alias("hit"))
    text = F.when(F.col("hit").isin(0, 1), "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("hit") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("who", "turn", role.alias("role"), text.alias("text"), (F.col("hit") != 0).alias("kept"), F.explode(copies).alias("copy")).drop("copy")


def _counts(turns: list, initials: list[str]) -> tuple[int, int]:
    known = [t for t in turns if t is not None]
    gaps = known[-1] - known[0] + 1 - len(set(known)) if known else 0
    return gaps, sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def faults(b: pa.RecordBatch, offsets: np.ndarray, whole: list[bool], part: int, seq: int) -> pa.RecordBatch:
    """Pieces with their symbols; rows that repeat an earlier one of the piece are known by now."""
    b = pa.RecordBatch.from_arrays(b.columns[:5], names=["who", "turn", "role", "text", "kept"])
    who = b.column(0).take(pa.array(offsets[:-1]))
    stays = b.column(4).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(stays)])[offsets]
    b = b.filter(b.column(4))
    roles, texts = b.column(2), b.column(3)
    empty = pc.invert(pc.match_substring_regex(texts, r"[^ \t-\r]")).to_numpy(zero_copy_only=False)
    short = pc.invert(pc.match_substring_regex(texts, r"[.!?][ \t-\r]*\z")).to_numpy(zero_copy_only=False)
    initials = [r[:1] for r in roles.to_pylist()]
    digests, symbols = [], np.zeros(b.num_rows, np.uint8)
    for a, z in zip(offsets[:-1], offsets[1:]):
        seen = set()
        for row in range(a, z):
            if empty[row]:
                digests.append(None)
                continue
            role = roles[row].as_py().encode()
            digest = hashlib.sha256(b"%d:" % len(role) + role + texts[row].as_py().encode()).digest()
            if digest in seen:
                digests.append(b"")
            else:
                seen.add(digest)
                digests.append(digest)
                symbols[row] = symbol(initials[row], bool(short[row]))
    n = len(offsets) - 1
    columns = {
        "who": who, "part": pa.array([part] * n, pa.int32()), "seq": pa.array(range(seq, seq + n), pa.int32()), "whole": pa.array(whole),
        "symbols": pa.array([symbols[a:z].tobytes() for a, z in zip(offsets[:-1], offsets[1:])], pa.binary()), "digests": as_lists(pa.array(digests, pa.binary()), offsets),
        "turns": as_lists(b.column(1), offsets), "roles": as_lists(roles, offsets), "texts": as_lists(texts, offsets), "initials": as_lists(pa.array(initials, pa.string()), offsets),
    }
    return pa.RecordBatch.from_pydict(columns)


def solved(b: pa.RecordBatch) -> pa.RecordBatch:
    """Repairs pieces. A whole conversation begins and ends here; else ``state`` and ``rest`` say how it stands on either side."""
    out = []
    for r in b.to_pylist():
        state, rest, end = (START, END, True) if r["whole"] else (r["state"], tuple(r["rest"]), r["last"])
        audit, _ = unroll(r["symbols"], state, rest, end)
        lines, cost = enacted(audit, state, r["symbols"], r["roles"], r["texts"])
        gaps, illegal = _counts(r["turns"], r["initials"])
        out.append((r["who"], r["part"], r["seq"], r["whole"], gaps, *fault_counts(r["symbols"], r["digests"]), illegal, cost, audit, lines))
    types = [pa.string(), pa.int32(), pa.int32(), pa.bool_(), *[pa.int64()] * 6, pa.string(), pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=MADE)


def fault_counts(symbols: bytes, digests: list) -> tuple[int, int, int]:
    empty = sum(d is None for d in digests)
    return empty, sum(s == MUST_GO for s in symbols) - empty, sum(s != MUST_GO and (s - 1) % 2 for s in symbols)


def without_late(b: pa.RecordBatch) -> pa.RecordBatch:
    """Symbols of pieces after rows that an earlier piece holds have become ones that must go, and the product of their matrices."""
    symbols = []
    for own, late in zip(b.column("symbols").to_pylist(), b.column("late").to_pylist()):
        own = bytearray(own)
        for row in late or []:
            own[row] = MUST_GO
        symbols.append(bytes(own))
    matrices = [[x for row in product(s) for x in row] for s in symbols]
    return pa.RecordBatch.from_arrays([b.column("who"), b.column("part"), b.column("seq"), pa.array(symbols, pa.binary()), pa.array(matrices, pa.list_(pa.int64()))], names=["who", "part", "seq", "symbols", "matrix"])


def _costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Backwards over the pieces of a conversation: the costs of what comes after each."""
    who, rest = None, END
    for b in batches:
        after, last = [], []
        for name, matrix in zip(b.column(0).to_pylist(), b.column(3).to_pylist()):
            last.append(name != who)
            if name != who:
                who, rest = name, END
            after.append(list(rest))
            rest = applied(tuple(tuple(matrix[4 * i : 4 * i + 4]) for i in STATES), rest)
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(after, pa.list_(pa.int64())), pa.array(last)], names=["who", "part", "seq", "rest", "last"])


def _ends(b: pa.RecordBatch) -> pa.RecordBatch:
    """For each state a piece may begin in the one it ends in."""
    ends = [[unroll(s, i, tuple(rest), False)[1] for i in STATES] for s, rest in zip(b.column("symbols").to_pylist(), b.column("rest").to_pylist())]
    return pa.RecordBatch.from_arrays([b.column("who"), b.column("part"), b.column("seq"), pa.array(ends, pa.list_(pa.int64())), *(b.column(c) for c in ("least", "most", "first", "final", "n"))], names=["who", "part", "seq", "ends", "least", "most", "first", "final", "n"])


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forwards over the pieces of a conversation: the state each begins in, and what its counts lack at the border to the one before."""
    who, state, turn, initial = None, START, None, None
    for b in batches:
        out = []
        for r in b.to_pylist():
            if r["who"] != who:
                who, state, turn, initial = r["who"], START, None, None
            between, illegal = 0, 0
            if r["least"] is not None:
                between = 0 if turn is None else r["least"] - turn - 1 if r["least"] > turn else 0
                turn = r["most"]
            if r["n"]:
                illegal = int(initial is not None and initial + r["first"] not in ("su", "ua", "au"))
                initial = r["final"]
            out.append((state, between, illegal))
            state = r["ends"][state]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(c, pa.int64()) for c in zip(*out))], names=["who", "part", "seq", "state", "between", "border"])


def repaired(rows: DataFrame) -> DataFrame:
    """Pieces of repaired conversations (see ``REPAIRED``): counts of faults, cost, audit and the rows as ``role:text``. Pieces of one conversation are in order of (part, seq)."""
    keys = ["who", F.col("turn").asc_nulls_first(), "role", "shuffled"]
    sorted_ = ordered(rows.withColumn("shuffled", F.xxhash64("text")), keys).select("who", "turn", "role", "text", "kept")
    cut = written(pieces(sorted_, faults, PIECE))
    done = map_batches(cut.filter("whole"), solved, REPAIRED)

    # what null conversations are called by from here on; no id is the empty text
    parts = cut.filter("not whole").withColumn("who", F.coalesce("who", F.lit("")))
    place = ["who", "part", "seq"]
    lists = parts.select(*place, F.posexplode("digests").alias("row", "digest")).filter("length(digest) > 0").withColumn("at", F.struct("part", "seq"))
    early = lists.groupBy("who", "digest").agg(F.min("at").alias("early"), F.count("*").alias("n")).filter("n > 1").drop("n")
    late = lists.join(early, ["who", "digest"]).filter(F.col("at") > F.col("early")).groupBy(*place).agg(F.collect_list("row").alias("late"))
    slim = parts.select(*place, "symbols").join(late, place, "left")
    matrices = written(map_batches(slim, without_late, f"{PLACE}, symbols binary, matrix array<long>"))

    def streamed(df: DataFrame, function, schema: str, backwards: bool = False) -> DataFrame:
        order = [F.col(c).desc() if backwards else F.col(c) for c in place]
        return df.repartition("who").sortWithinPartitions(*order).mapInArrow(function, schema)

    costs = written(streamed(matrices.select(*place, "matrix"), _costs, f"{PLACE}, rest array<long>, last boolean", True))
    facts = parts.select(
        *place, F.array_min("turns").alias("least"), F.array_max("turns").alias("most"), F.get("initials", F.lit(0)).alias("first"), F.try_element_at("initials", F.lit(-1)).alias("final"), F.size("initials").alias("n"),
    )
    known = matrices.select(*place, "symbols").join(costs, place)
    with_ends = map_batches(known.join(facts, place), _ends, f"{PLACE}, ends array<long>, least long, most long, first string, final string, n int")
    states = written(streamed(with_ends, _states, f"{PLACE}, state long, between long, border long"))
    joined = parts.drop("symbols").join(known, place).join(states, place)
    split = map_batches(joined.select(*[x.split()[0] for x in PIECE.split(", ")], "state", "rest", "last"), solved, REPAIRED)
    split = split.join(states.select(*place, "between", "border"), place).withColumns({
        "gaps": F.col("gaps") + F.col("between"), "illegal": F.col("illegal") + F.col("border"), "who": F.nullif("who", F.lit(""))
    })
    return done.unionByName(split.select(*done.columns))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and digest of split conversations, from their pieces in order."""
    who, audit, digest, begun = None, [], None, False

    def row():
        return pa.RecordBatch.from_arrays([pa.array([who], pa.string()), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], names=["who", "audit", "repaired_sha256"])

    for b in batches:
        for name, own, lines in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(4)):
            if digest is None or name != who:
                if digest is not None:
                    yield row()
                who, audit, digest, begun = name, [], hashlib.sha256(), False
            audit.append(own)
            for line in lines:
                digest.update((b"\n" if begun else b"") + line.as_py().encode())
                begun = True
    if digest is not None:
        yield row()


def summary(repairs: DataFrame, id_type: str = "long") -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    repairs = written(repairs)
    whole = repairs.filter("whole").select("who", *counts, "audit", F.sha2(F.array_join("repaired", "\n"), 256).alias("repaired_sha256"))
    split = repairs.filter("not whole").withColumn("who", F.coalesce("who", F.lit("")))
    totals = split.groupBy("who").agg(*[F.sum(c).alias(c) for c in counts])
    text = split.select("who", "part", "seq", "audit", "repaired").repartition("who").sortWithinPartitions("who", "part", "seq")
    text = text.mapInArrow(_hashed, "who string, audit string, repaired_sha256 string")
    split = totals.join(text, "who").withColumn("who", F.nullif("who", F.lit("")))
    return whole.unionByName(split.select(*whole.columns)).select(F.col("who").cast(id_type).alias("conv_id"), *counts, "audit", "repaired_sha256")
