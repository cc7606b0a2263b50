"""Repair and prefix trie of conversations, and SimHash classes, against brute force."""

import hashlib
import random
import re
import zlib

import pytest
import xxhash

from plcatlas.llm import prefix_trie, repair, simhash, turns

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, who long, part int, digest string, key binary"


def conversations():
    rnd = random.Random(5)
    rows, extra = [], (7, 7, "x", b"y")
    opening = [("system", "Be kind."), ("user", "Hello there!"), ("assistant", "Hi."), ("user", "What now?")]
    for c in range(130):
        said = opening[: rnd.randint(0, 4)]
        for t in range(rnd.randint(1, 7)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            said.append((role, rnd.choice(["Yes.", "No!", "and so", "  ", "", None, "One two three.", "Étrange ? \n", f"turn {rnd.randint(0, 50)}."])))
        for t, (role, text) in enumerate(said):
            rows.append((c, t if t != 3 else t + rnd.randint(0, 2), role, text, *extra))
    rows += [(200, None, "user", "First.", *extra), (200, 5, "assistant", "x" * 70_000 + ".", *extra), (200, -3, "user", "so long", *extra)]
    rows += [(None, 1, "user", "no id.", *extra), (None, 2, "assistant", "none.", *extra), (-40, 0, "user", "below.", *extra)]
    rows += [(300, t, ("user", "assistant")[t % 2], f"long {t % 97}.", *extra) for t in range(700)]
    rows += [(301, t, ("user", "assistant")[t % 2], f"long {t % 97}.", *extra) for t in range(650)]
    rows += [(320, t, "user", "Again.", *extra) for t in range(300)]
    return rows


def ordered_turns(rows, kept):
    by = {}
    for c, t, role, text, *_ in rows:
        by.setdefault(c, [])
        if kept(c, t):
            by[c].append((t, role, text))
    return by


def least(rows):
    """Cheapest edits by a forward search over whole audits."""
    states = {0: (0, "", ())}
    nxt = {0: 2, 1: 2, 3: 2, 2: 3}

    def insert(states):
        for _ in range(3):
            for q, (cost, audit, out) in list(states.items()):
                made = (cost + 3, audit + "I", (*out, ("assistant:" if q == 2 else "user:")))
                if nxt[q] not in states or made < states[nxt[q]]:
                    states[nxt[q]] = made
        return states

    for role, text, fault in rows:
        after = {}
        for q, (cost, audit, out) in insert(states).items():
            add = 3 if fault == "truncated" else 0
            options = [(q, cost + 4, audit + "D", out)]
            if fault not in ("blank", "duplicate"):
                options.append((nxt[q], cost + 3 + add, audit + "R", (*out, ("assistant:" if q == 2 else "user:") + text)))
                to = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(role[:1], {}).get(q)
                if to is not None:
                    options.append((to, cost + add, audit + "K", (*out, f"{role}:{text}")))
            for to, *made in options:
                if to not in after or tuple(made) < after[to]:
                    after[to] = tuple(made)
        states = after
    return min(v for q, v in insert(states).items() if q in (0, 3)) if rows else (0, "", ())


def repaired_by_hand(rows):
    by = {}
    for c, t, role, text, *_ in rows:
        blank = lambda x: " " if x is None else str(x)
        hit = zlib.crc32(f"{blank(c)}:{blank(t)}".encode()) % 20
        own = by.setdefault(c, [])
        role, text = blank(role), blank(text)
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        own += [(t, "user" if hit == 4 else role, text)] * {0: 0, 3: 2}.get(hit, 1)
    want = {}
    for c, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, judged = set(), []
        for _, role, text in own:
            said = re.sub(r"[ \t-\r]+\Z", "", text)
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role, text, fault))
        known = {t for t, *_ in own if t is not None}
        cost, audit, lines = least(judged)
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(judged, judged[1:])]
        want[c] = (
            max(known) - min(known) + 1 - len(known) if known else 0, *(sum(j[2] == f for j in judged) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return want


@pytest.mark.parametrize("carry", [0, turns.LONG_CARRY])
def test_repair(spark, carry, monkeypatch):
    """With no carry every conversation at the end of a batch is split, so both ways are taken."""
    monkeypatch.setattr(turns, "LONG_CARRY", carry)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37" if not carry else "10000")
    rows = conversations()
    # no two rows of one turn differ
    rows = list({(r[0], r[1]): r for r in rows}.values())
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    try:
        got = {r[0]: tuple(r[1:]) for r in repair.summary(repair.repaired(repair.damaged(docs))).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = repaired_by_hand(rows)
    assert {k: (got.get(k), v) for k, v in want.items() if got.get(k) != v} == {} and len(got) == len(want)


def test_repair_repeats_and_empty(spark):
    rows = [(1, 0, "user", "Same.")] * 5 + [(1, 1, "assistant", "Too.")] * 2 + [(None, None, None, None)] * 3
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r[0]: tuple(r[1:]) for r in repair.summary(repair.repaired(repair.damaged(df))).collect()}
    assert got == repaired_by_hand(rows) and set(got) == {1, None}
    assert repair.summary(repair.repaired(repair.damaged(df.limit(0)))).collect() == []


def test_runs_equal_single_steps():
    rnd = random.Random(2)
    for _ in range(200):
        symbols = bytes(rnd.choice(range(9)) for _ in range(rnd.randint(0, 6)) for _ in range(rnd.randint(1, 20)))
        rest = repair.END
        for code in reversed(symbols):
            rest = repair.applied(repair.power(code, 0), rest)
        assert repair.applied(repair.product(symbols), repair.END) == rest
        audit, _ = repair.unroll(symbols, 0, repair.END, True)
        assert repair.enacted(audit, 0, symbols, ["s"] * len(symbols), [""] * len(symbols))[1] == rest[0]


def trie_by_hand(rows, family=20):
    by = {}
    for c, t, role, text, *_ in rows:
        if c is not None:
            by.setdefault(c, []).append((t, role or "", text or ""))
    for own in by.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    made = {}
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % family if c >= 0 else -(-c % family))
        made[c] = [r[1:] for r in by.get(base, [])[:h] + own[h:]]
    members, nodes = {}, {}
    for c, said in made.items():
        for d in range(len(said) + 1):
            members.setdefault(tuple(said[:d]) if d < 300 else (c // 300, d, hashlib.sha256(repr(said[:d]).encode()).hexdigest()), []).append((c, d))
    path = {c: [] for c in made}
    for k, own in members.items():
        for c, d in own:
            path[c].append((d, k))
    for c in path:
        path[c] = [k for _, k in sorted(path[c], key=lambda x: x[0])]
    children, parent = {k: set() for k in members}, {}
    for c, p in path.items():
        for a, b in zip(p, p[1:]):
            children[a].add(b)
            parent[b] = a
    words = {path[c][d + 1]: len(WORD.findall(t[1])) for c, said in made.items() for d, t in enumerate(said)}
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for k, own in members.items():
        up, value, leaf = k, (len(own) - 1) * words.get(k, 0), not children[k]
        while up is not None:
            leaves[up] += leaf
            saved[up] += value
            up = parent.get(up)
    for k, own in members.items():
        depth = own[0][1]
        ends = sorted(c for c, d in own if d == len(made[c]))
        nodes[(min(own)[0], depth)] = (
            min(members[parent[k]])[0] if k in parent else None, len(own), len(children[k]), leaves[k], saved[k], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return nodes


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("carry,shard,block", [(0, 3, 16), (turns.LONG_CARRY, prefix_trie.SHARD, prefix_trie.BLOCK)])
def test_trie(spark, carry, shard, block, monkeypatch):
    monkeypatch.setattr(turns, "LONG_CARRY", carry)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37" if not carry else "10000")
    rows = list({(r[0], r[1]): r for r in conversations()}.values())
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    try:
        got = prefix_trie.with_digests(prefix_trie.prefix_trie(df, shard=shard, block=block)).select(*COLUMNS).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = trie_by_hand(rows)
    assert len(got) == len(want)
    assert {(r[0], r[1]): (tuple(r[2:]), want.get((r[0], r[1]))) for r in got if tuple(r[2:]) != want.get((r[0], r[1]))} == {}


def test_trie_repeats_and_empty(spark):
    rows = [(20, 0, "user", "a b"), (20, 0, "user", "a b"), (21, 0, "user", "a b"), (22, None, None, None), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r[0], r[1]): tuple(r[2:]) for r in prefix_trie.with_digests(prefix_trie.prefix_trie(df)).select(*COLUMNS).collect()}
    assert got == trie_by_hand(rows)
    assert prefix_trie.with_digests(prefix_trie.prefix_trie(df.limit(0))).collect() == []


def fingerprint_by_hand(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] if len(words) > 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_by_hand(prints, radius=4):
    """Smallest id that is reachable, for prints by id; None is no id."""
    top = list(range(len(prints)))

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for i, (_, x) in enumerate(prints):
        for j, (_, y) in enumerate(prints[:i]):
            if (x ^ y).bit_count() <= radius:
                top[find(i)] = find(j)
    least = {}
    for i, (c, _) in enumerate(prints):
        if c is not None:
            least[find(i)] = min(c, least.get(find(i), c))
    return [(c, least.get(find(i))) for i, (c, _) in enumerate(prints)]


def near_texts():
    rnd = random.Random(8)
    vocabulary = [f"W{k}é" for k in range(400)]
    base = [rnd.choice(vocabulary) for _ in range(300)]
    out = [None, "", " \x0b\n", "one", "One  two\nthree", "one two three", "\x1c one\x1ftwo", "x" * 60_000]
    for k in range(120):
        words = list(base)
        for _ in range(k % 9):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        out.append((" " if k % 3 else "\n ").join(words))
    out += [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 60))) for _ in range(80)]
    return out + out[8:20] + [" ".join(rnd.choice(vocabulary) for _ in range(40_000))]


def test_simhash(spark):
    rows = [(i if i % 13 else None, t, 1, "x", 5) for i, t in enumerate(near_texts())] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, print long, fingerprint string, component long").repartition(5)
    got = simhash.near_classes(df).collect()
    prints = [(c, fingerprint_by_hand(t)) for c, t, *_ in rows]
    want = sorted(((c, f"{p:016x}", x) for (c, p), (_, x) in zip(prints, classes_by_hand(prints))), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert 3 < len({x for *_, x in want}) < 150
    assert simhash.near_classes(df.limit(0)).collect() == []


@pytest.mark.parametrize("pass_bytes,shard", [(1500, 1 << 21), (200, 1 << 10)])
def test_simhash_links(spark, pass_bytes, shard, monkeypatch):
    """Classes at the very limit, chains included, for many and few shards and passes."""
    monkeypatch.setattr(simhash, "PASS_BYTES", pass_bytes)
    monkeypatch.setattr(simhash, "SHARD", shard)
    rnd = random.Random(4)
    prints = []
    for _ in range(40):
        x = rnd.getrandbits(64)
        prints.append(x)
        for _ in range(rnd.randint(0, 6)):
            for b in rnd.sample(range(64), rnd.choice([1, 3, 4, 4, 5, 6])):
                x ^= 1 << b
            prints.append(x)
    prints = sorted(set(prints))
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "print long")
    top = {p: p for p in prints}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for r in simhash.links(df).collect():
        a, b = r.a % (1 << 64), r.b % (1 << 64)
        assert a in top and b in top
        top[find(a)] = find(b)
    want = classes_by_hand(list(enumerate(prints)))
    got = {}
    for i, p in enumerate(prints):
        got.setdefault(find(p), []).append(i)
    assert {i: g[0] for g in got.values() for i in g} == dict(want)
