"""Secret scan with a trigram inverted index, in DataFrame functions only.

Method: each rule's regular expression is turned into a Boolean query over trigrams that every match must contain (alternatives of sets that have to occur together). One
pass over the texts lists the query trigrams each text holds (of each set the ``TELLING`` most selective ones); these postings are intersected with the queries, and only the candidates
of a rule are verified with its expression. A rule without mandatory trigrams is verified on every text.

Spans are found from left to right without overlap within a rule; positions are code points, ends are exclusive. Matches whose value
is too short are dropped after matching, as they take their place in the text all the same.

Defined cases: a null text counts as empty and has no spans; texts of any length are read as a whole, in time that grows with their matches; an empty table gives an empty result; repeated rows are judged alike; rows without an id are kept; other columns are ignored.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plcatlas.llm.common import back_to_id, order_key

MOST_SETS = 64
TELLING = 2
RUN = 256
SPANS = "array<struct<start:int,kind:int,end:int>>"
# Fixed value: letters from frequent to rare, to tell which trigrams select most.
FREQUENT = " etaoinsrhldcumfpgwybvkxjqz"


@dataclasses.dataclass(frozen=True)
class Rule:
    """``group`` must have ``least`` characters; ``base`` rules come first in the order of kinds."""

    kind: str
    pattern: str
    group: int
    least: int
    base: bool = False


# The base rules, then rules of the method's own.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]+", 0, 16, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("github", r"github_pat_[A-Za-z0-9_]+", 0, 33),
    Rule("slack", r"xox[baprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
)


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Sets of lower-case trigrams, of which a match contains at least one set completely; empty if nothing is mandatory."""
    return _query(re._parser.parse(pattern))


def _query(tree) -> list[frozenset[str]]:
    kinds, sets, run = re._constants, [frozenset()], ""

    def both(a: list[frozenset[str]], b: list[frozenset[str]]) -> list[frozenset[str]]:
        # a requirement that would make too many sets is left out, which only lets more candidates through
        return [x | y for x in a for y in b] if b and len(a) * len(b) <= MOST_SETS else a

    def grams(text: str) -> list[frozenset[str]]:
        text = text.lower()
        return [frozenset(text[i : i + 3] for i in range(len(text) - 2))]

    for kind, value in tree:
        if kind is kinds.LITERAL and value < 128:
            run += chr(value)
            continue
        sets, run = both(sets, grams(run)), ""
        if kind is kinds.SUBPATTERN:
            sets = both(sets, _query(value[3]))
        elif kind is kinds.BRANCH:
            choices = [_query(x) for x in value[1]]
            sets = both(sets, [s for c in choices for s in c] if all(choices) else [])
        elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT) and value[0] > 0:
            sets = both(sets, _query(value[2]))
    sets = both(sets, grams(run))
    return [] if any(not s for s in sets) else sets


def selective(grams: frozenset[str], n: int = TELLING) -> list[str]:
    """The trigrams with the rarest characters; fewer tests, and still every match passes them."""
    return sorted(grams, key=lambda g: (-sum(FREQUENT.find(c) % 99 for c in g), g))[:n]


def fast_pattern(rule: Rule) -> str:
    """For a rule that is a fixed start and one run of characters, a match that is too short hides no other, so its length can be asked for at once."""
    found = re.fullmatch(r"([A-Za-z0-9]*)(\[[^\]]+\])\+", rule.pattern)
    return f"{found[1]}{found[2]}{{{max(1, rule.least - len(found[1]))},}}" if found and rule.group == 0 else rule.pattern


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` has it in a function over an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(steps: Column) -> Column:
    return F.aggregate(steps, F.lit(0), lambda at, x: at + x["gap"] + x["size"])


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """An array of (start, order, end) of the rule's matches: the pieces between matches give the positions.

    Positions are running sums. Matches are cut into runs of ``RUN``; the runs' totals give where each run begins, and only within a run are
    spans appended one by one, so the time grows with the number of matches and not with its square.
    """
    pattern = fast_pattern(rule)
    matches, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def measured(x: Column) -> Column:
        value = F.length(F.regexp_extract(x["match"], pattern, rule.group) if rule.group else x["match"])
        return F.struct(F.length(x["piece"]).alias("gap"), F.coalesce(F.length(x["match"]), F.lit(0)).alias("size"), F.coalesce(value, F.lit(-1)).alias("value"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + x["size"]
        span = F.struct(start.alias("start"), F.lit(order).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["value"] >= rule.least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    def within(run: Column, start: Column) -> Column:
        empty = F.struct(start.alias("at"), F.array().cast(SPANS).alias("spans"))
        return F.aggregate(run, empty, step, lambda state: state["spans"])

    def cut(steps: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / RUN).cast("int")), lambda k: F.slice(steps, k * RUN + 1, RUN))

    def starts(runs: Column) -> Column:
        # one number a run
        return F.aggregate(runs, F.array(F.lit(0)), lambda at, run: F.array_append(at, F.element_at(at, -1) + total(run)))

    def placed(runs: Column) -> Column:
        return let(starts(runs), lambda at: F.flatten(F.transform(runs, lambda run, k: within(run, F.get(at, k)))))

    steps = F.transform(F.arrays_zip(pieces.alias("piece"), matches.alias("match")), measured)
    return let(steps, lambda own: let(cut(own), placed))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the number of spans of each base rule (n_<kind>), base_sha256 and spans."""
    spark = docs.sparkSession
    queries = [(k, trigram_query(rule.pattern)) for k, rule in enumerate(rules)]
    clauses = [(k, n, gram, min(TELLING, len(s))) for k, sets in queries for n, s in enumerate(sets) for gram in selective(s)]
    grams = sorted({c[2] for c in clauses})
    rows = docs.select(order_key(id_column).alias("ord"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("same", F.xxhash64("text"))

    folded = rows.select("ord", "same", F.lower("text").alias("folded"))
    held = F.array_compact(F.array(*[F.when(F.contains("folded", F.lit(g)), F.lit(g)) for g in grams]))
    postings = folded.select("ord", "same", held.alias("grams")).select("ord", "same", F.explode("grams").alias("gram"))
    # a fixed table: one row a rule, set and trigram
    wanted = F.broadcast(spark.createDataFrame(clauses, "rule int, nth int, gram string, size int"))
    candidates = (
        postings.distinct().join(wanted, "gram").groupBy("ord", "same", "rule", "nth").agg(F.count("*").alias("n"), F.first("size").alias("size"))
        .filter("n = size").groupBy("ord", "same").agg(F.collect_set("rule").alias("rules"))
    )
    joined = rows.join(candidates, ["ord", "same"], "left")
    nothing = F.array().cast(SPANS)
    found = {}
    for k, rule in enumerate(rules):
        spans = spans_of(F.col("text"), rule, k)
        found[f"spans_{k}"] = F.when(F.array_contains("rules", k), spans).otherwise(nothing) if queries[k][1] else spans
    joined = joined.select("ord", *[v.alias(k) for k, v in found.items()])
    base = [k for k, rule in enumerate(rules) if rule.base]
    kinds = F.array(*[F.lit(rule.kind) for rule in rules])

    def listed(which: list[int]) -> Column:
        every = F.array_sort(F.concat(*[F.col(f"spans_{k}") for k in which]))
        return F.array_join(F.transform(every, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")

    return joined.select(
        back_to_id("ord").alias("doc_id"), *[F.size(f"spans_{k}").cast("long").alias(f"n_{rules[k].kind}") for k in base],
        F.sha2(listed(base), 256).alias("base_sha256"), listed(list(range(len(rules)))).alias("spans"),
    )
