"""From source texts to graph tables.

A file is one row of the corpus. Its lines are reduced to facts (declarations, section marks, calls ...) before
anything is shuffled; only those facts meet in windows per file, which give every fact its unit and section. A declaration
that runs over several lines is put on one line inside the row first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plcatlas.functions.scanner import harvested, stripped
from plcatlas.functions.standard import is_conversion, standard_names
from plcatlas.session import cut_lineage

NAME = r"[A-Za-z_]\w*"
OUTER_KINDS = ("FUNCTION_BLOCK", "PROGRAM", "FUNCTION", "CLASS", "INTERFACE")
INNER_KINDS = ("METHOD", "PROPERTY")
MODIFIERS = "PUBLIC|PRIVATE|PROTECTED|INTERNAL|ABSTRACT|FINAL|OVERRIDE|STATIC"

# Variable sections.
SECTIONS = (
    "VAR_INPUT", "VAR_OUTPUT", "VAR_IN_OUT", "VAR_TEMP", "VAR_GLOBAL", "VAR_EXTERNAL", "VAR_CONSTANT", "VAR",
)

_UNITS = "|".join(OUTER_KINDS + INNER_KINDS)
_OUTSIDE_STRINGS = r"(?=(?:[^']*'[^']*')*[^']*$)"
_ALONE = rf"(?i)(?=[EVS])(?<![.\w])(END_(?:{_UNITS}|TYPE|STRUCT|VAR|CASE)|{'|'.join(SECTIONS)}|STRUCT)(?!\w){_OUTSIDE_STRINGS}"
_HEAD = rf"(?i)(?=[CFIMPT])(?<![.\w])(?=(?:{_UNITS}|TYPE)\s+{NAME}){_OUTSIDE_STRINGS}"
_NEXT_LABEL = rf";\s*(?=[\w.#]+(?:\s*(?:,|\.\.)\s*[\w.#]+)*\s*:(?!=)){_OUTSIDE_STRINGS}"
_BREAK = "\u0001"

# A declaration may run over several lines; its lines become one before a file is cut into lines. While that happens every
# line carries its number, and so does every break that was taken out.
_NUMBER, _TAKEN = "\u0003", "\u0002"
_SECTION = rf"(?i)^(?:{'|'.join(SECTIONS)}|STRUCT)(?!\w)(?:\s+(?:CONSTANT|RETAIN|NON_RETAIN|PERSISTENT)(?!\w))*"
# what a keyword begins with is tested first: few letters of a text get further
_EDGE = (
    rf"(?i)(?=[EVS])(?<![.\w])(?=(?:END_\w+|{'|'.join(SECTIONS)}|STRUCT)(?!\w))"
    r"(?=(?:[^'\n]*'[^'\n]*')*[^'\n]*(?:\n|\z))"
)
_WRAPPED = r"(?<=[^;}\s])[ \t\r\f]*\n(?!\s*\z)"
_INNER_BREAK = rf"(?:(?<=[^;}}\s{_NUMBER}])|(?!\A)\G)[ \t\r\f]*\n(\d+){_NUMBER}(?!\s*\z)"
_LAST_TAKEN = rf"({_TAKEN}(\d+){_NUMBER}(?:'[^'\n]*'|[^{_TAKEN}\n;'])*+;)"

_UNIT_START = rf"(?i)^({_UNITS})\s+(?:(?:{MODIFIERS})\s+)*({NAME})"
_TYPE_OPEN = rf"(?i)^TYPE(?:\s+{NAME}|$)"
_TYPE_NAME = rf"(?i)^(?:TYPE\s+)?({NAME})\s*(?:\(\s*[\w.]+\s*\)\s*)?:(?!=)\s*(.*)$"
# quantifiers are possessive: a word is tried once and not once per letter
_WORD = r"[A-Za-z_]\w*+"
_DECLARATION = (
    rf"(?<![\w.])({_WORD}(?:\s*+,\s*+{_WORD})*+)\s*+(?:(?i:AT)\s++[^\s:]++\s*+)?:(?!=)\s*+((?:'(?:[^']|'')*+'|[^;'])++)"
)
_CALL = rf"\b({_WORD})\s*+\("
_CASE = r"(?i)^CASE\s+(.+?)\s+OF\b(.*)$"
_LABEL = r"(?i)^(?:CASE\s+.+?\s+OF\s+)?([\w.#]+(?:\s*(?:,|\.\.)\s*[\w.#]+)*)\s*:(?!=)"
_ASSIGN = rf"({NAME}(?:\.{NAME})*)\s*:=\s*([\w.#]+)\s*(?:;|$)"
_HEADER = rf"(?i)\b(?:FUNCTION_BLOCK|PROGRAM|CLASS|INTERFACE)\s+(?:(?:{MODIFIERS})\s+)*"
_DOTTED = rf"{NAME}(?:\.{NAME})*+"
_NAMES = rf"{_DOTTED}(?:\s*,\s*{_DOTTED})*+"
_CLAUSE = rf"{_HEADER}({NAME})(?:\s+EXTENDS\s+({_NAMES}))?(?:\s+IMPLEMENTS\s+({_NAMES}))?"
_UNIT_HEAD = rf"{_UNIT_START}(?:\s+EXTENDS\s+{_NAMES})?(?:\s+IMPLEMENTS\s+{_NAMES})?"


def clean(corpus: DataFrame) -> DataFrame:
    """``(path, code)``: the text without comments, on the same lines."""
    return corpus.select("path", stripped(F.col("content")).alias("code"))


def comments(corpus: DataFrame) -> DataFrame:
    return corpus.select("path", F.explode(harvested(F.col("content"))).alias("c")).select("path", "c.line", "c.text")


def comment_density(corpus: DataFrame) -> DataFrame:
    """Comments and lines per file; computed inside the row."""
    found = corpus.select("path", F.size(F.split("content", "\n", -1)).alias("lines"), F.size(harvested(F.col("content"))).alias("comments"))
    return found.withColumn("density", F.col("comments") / F.col("lines"))


def _text(value: Column) -> Column:
    """Null instead of the empty text a failed extraction gives."""
    return F.nullif(value, F.lit(""))


def _pieces(code: Column) -> Column:
    """A text cut where variable sections, structures and ends of blocks stand."""
    return F.split(code, _EDGE, -1)


def _wrapped(code: Column) -> Column:
    """Whether a declaration of a text runs over the end of a line."""
    body = lambda piece: F.regexp_replace(piece, _SECTION, "")
    return F.exists(_pieces(code), lambda p: p.rlike(_SECTION) & body(p).rlike(_WRAPPED))


def _joined_lines(code: Column) -> Column:
    """Lines ``number, mark, text`` in which every declaration stands on the line it starts on."""
    plain = F.split(F.translate(code, f"{_BREAK}{_TAKEN}{_NUMBER}", "   "), "\n", -1)
    numbered = F.array_join(F.transform(plain, lambda t, i: F.concat((i + 1).cast("string"), F.lit(_NUMBER), t)), "\n")

    def joined(piece: Column) -> Column:
        body = F.regexp_replace(F.regexp_replace(piece, _SECTION, ""), _INNER_BREAK, f"{_TAKEN}$1{_NUMBER}")
        # what follows the end of a wrapped declaration stands on the line where that one ends
        body = F.regexp_replace(body, _LAST_TAKEN, f"$1\n$2{_NUMBER}")
        body = F.regexp_replace(body, rf"{_TAKEN}\d+{_NUMBER}", " ")
        return F.when(piece.rlike(_SECTION), F.concat(F.regexp_extract(piece, _SECTION, 0), body)).otherwise(piece)

    return F.split(F.array_join(F.transform(_pieces(numbered), joined), ""), "\n", -1)


def segments(cleaned: DataFrame) -> DataFrame:
    """Statements lines ``(path, line, part, text)``: a line is split where a declaration or section keyword stands."""
    code, upper = F.col("code"), F.col("_upper")
    flat = F.regexp_replace(code, r"\s+", " ")
    heads = F.regexp_extract_all(flat, F.lit(_CLAUSE), F.lit(0))
    has_sections = upper.contains("VAR") | upper.contains("STRUCT")
    # what belongs to the file is made before its lines are; beside them it would be made once a line
    files = cleaned.select("path", "code", F.upper(code).alias("_upper")).select(
        "path", "code", F.when(has_sections, _wrapped(code)).otherwise(False).alias("wrapped"),
        upper.contains("END_TYPE").alias("has_types"), upper.contains("END_CASE").alias("has_cases"),
        F.when(upper.contains("EXTENDS") | upper.contains("IMPLEMENTS"), heads).alias("heads"),
    )
    lines = files.select(
        "path", "wrapped", "has_types", "has_cases", "heads",
        F.posexplode(F.when(F.col("wrapped"), _joined_lines(code)).otherwise(F.split("code", "\n", -1))).alias("at", "text"),
    )
    number = F.substring_index("text", _NUMBER, 1).cast("int")
    lines = lines.select(
        "path", "has_types", "has_cases",
        # headers belong to the file; its first line carries them
        F.when(F.col("at") == 0, F.col("heads")).alias("heads"),
        "at", F.when(F.col("wrapped"), number).otherwise(F.col("at") + 1).alias("line"),
        F.when(F.col("wrapped"), F.substring_index("text", _NUMBER, -1)).otherwise(F.col("text")).alias("text"),
    )
    # plain substring tests come first: few lines hold a keyword, and only those meet the patterns
    big, text = F.col("_big"), F.col("text")
    lines = lines.withColumn("_big", F.upper("text"))
    for wanted, pattern, to in (
        (_any_of(big, "END_", "VAR", "STRUCT"), _ALONE, f"{_BREAK}$1{_BREAK}"),
        (_any_of(big, *OUTER_KINDS, *INNER_KINDS, "TYPE"), _HEAD, _BREAK),
        # branches of a CASE that share a line
        (F.col("has_cases"), _NEXT_LABEL, f";{_BREAK}"),
    ):
        lines = lines.withColumn("text", F.when(wanted, F.regexp_replace(text, pattern, to)).otherwise(text))
    parts = lines.select("path", "has_types", "has_cases", "heads", "at", "line",
                         F.posexplode(F.split("text", _BREAK, -1)).alias("part", "text"))
    parts = parts.withColumn("heads", F.when(F.col("part") == 0, F.col("heads")))
    # parts of a text line stay in order, also where two lines of the joined text have one number
    parts = parts.withColumn("part", F.col("at").cast("bigint") * (1 << 31) + F.col("part")).drop("at")
    trimmed = F.btrim(F.col("text"), F.lit(" \t\r\f\u000b\u00a0"))
    return parts.withColumn("text", trimmed).filter("text <> '' OR heads IS NOT NULL")


def _any_of(value: Column, *words: str) -> Column:
    found = value.contains(words[0])
    for word in words[1:]:
        found = found | value.contains(word)
    return found


def line_facts(parts: DataFrame) -> DataFrame:
    """The facts of every segment; segments without any are dropped."""
    parts = parts.withColumn("_big", F.upper("text"))
    text, big = F.col("text"), F.col("_big")
    nothing = F.array().cast("array<string>")
    is_unit = big.startswith("FUNCTION")
    for kind in OUTER_KINDS + INNER_KINDS:
        is_unit = is_unit | big.startswith(kind)
    ends = [f"END_{k}" for k in (*OUTER_KINDS, *INNER_KINDS, "TYPE", "STRUCT", "VAR", "CASE")]
    # a header declares its own name; what follows it on the line may call
    body = F.when(is_unit, F.regexp_replace(text, _UNIT_HEAD, "")).otherwise(text)
    calls = F.filter(
        F.array_except(F.regexp_extract_all(body, F.lit(_CALL), F.lit(1)), standard_names()),
        lambda c: ~c.startswith("_") & ~is_conversion(c),
    )
    # labels and assignments of branches; what they belong to is known once blocks are
    label = F.coalesce(_text(F.regexp_extract(text, _LABEL, 1)), F.when(big.rlike("^ELSE\\b"), "ELSE"))
    moves = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(_ASSIGN), F.lit(1)).alias("var"),
        F.regexp_extract_all(text, F.lit(_ASSIGN), F.lit(2)).alias("val"),
    )
    has_cases = F.col("has_cases")
    rows = parts.select(
        "path", "line", "part", "has_types", "text", "heads",
        F.when(has_cases & (text.contains(":") | big.startswith("ELSE")), label).alias("label"),
        F.when(has_cases & text.contains(":="), moves).alias("moves"),
        F.when(is_unit, _text(F.upper(F.regexp_extract(text, _UNIT_START, 1)))).alias("unit_kind"),
        F.when(is_unit, _text(F.regexp_extract(text, _UNIT_START, 2))).alias("unit_name"),
        F.when(big.isin(*ends), F.substr(big, F.lit(5))).alias("end_kind"),
        F.when(big.isin(*SECTIONS), big).alias("section_kind"),
        F.when(big.startswith("TYPE"), text.rlike(_TYPE_OPEN)).otherwise(False).alias("type_open"),
        (big == "STRUCT").alias("struct_open"),
        F.when(text.contains(":"), F.regexp_extract_all(text, F.lit(_DECLARATION), F.lit(0))).otherwise(nothing).alias("declared"),
        F.when(text.contains("("), calls).otherwise(nothing).alias("calls"),
        F.when(big.startswith("CASE"), _text(F.regexp_extract(text, _CASE, 1))).alias("case_of"),
    )
    keep = (
        F.col("unit_kind").isNotNull() | F.col("end_kind").isNotNull() | F.col("section_kind").isNotNull()
        | F.col("has_types") | (F.size("declared") > 0) | (F.size("calls") > 0)
        | F.col("heads").isNotNull() | F.col("case_of").isNotNull() | F.col("label").isNotNull() | (F.size("moves") > 0)
    )
    # the definition of a type is its text; no other file's lines leave the scan
    return rows.filter(keep).withColumn("text", F.when(F.col("has_types"), F.col("text"))).drop("has_types")


def with_scopes(facts: DataFrame) -> DataFrame:
    """Facts with the unit, section and type block they stand in.

    One shuffle and one sort per file; every scope is the last mark seen so far in the file. A method is left for its
    block at its own end, a block ends everything inside it.
    """
    so_far = W.partitionBy("path").orderBy("line", "part").rowsBetween(W.unboundedPreceding, 0)
    outer_start = F.col("unit_kind").isin(*OUTER_KINDS)
    inner_start = F.col("unit_kind").isin(*INNER_KINDS)
    outer_end = F.col("end_kind").isin(*OUTER_KINDS)
    inner_end = F.col("end_kind").isin(*INNER_KINDS)
    unit_mark = outer_start | inner_start | outer_end | inner_end

    def carried(*cases: tuple[Column, Column]) -> Column:
        mark = F.when(cases[0][0], cases[0][1])
        for when, value in cases[1:]:
            mark = mark.when(when, value)
        return F.last(mark, ignorenulls=True).over(so_far)

    unit = F.struct(F.col("unit_name").alias("name"), F.col("unit_kind").alias("kind"), "line")
    none = F.struct(
        F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("int").alias("line")
    )
    no_text = F.lit("")
    first = facts.select(
        "*",
        carried((outer_start, unit), (outer_end, none)).alias("outer"),
        carried((inner_start, unit), (inner_end | outer_start | outer_end, none)).alias("inner"),
        carried(
            (F.col("section_kind").isNotNull(), F.col("section_kind")),
            ((F.col("end_kind") == "VAR") | unit_mark, no_text),
        ).alias("section"),
        carried((F.col("type_open"), F.lit(True)), ((F.col("end_kind") == "TYPE") | unit_mark, F.lit(False))).alias("in_type"),
        carried(
            (F.col("struct_open"), F.lit(True)),
            (F.col("end_kind").isin("STRUCT", "TYPE") | F.col("type_open"), F.lit(False)),
        ).alias("in_struct"),
    )
    inside = F.coalesce("in_type", F.lit(False))
    in_struct = inside & F.coalesce("in_struct", F.lit(False))
    type_name = _text(F.regexp_extract("text", _TYPE_NAME, 1))
    type_start = inside & ~in_struct & ~F.col("struct_open") & F.col("end_kind").isNull() & type_name.isNotNull()
    owner = F.struct(type_name.alias("name"), "line", "part")
    second = first.withColumn("in_type", inside).withColumn("in_struct", in_struct).withColumn("_starts", type_start)
    no_owner = F.struct(
        F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("bigint").alias("part")
    )
    ends = F.col("type_open") | (F.col("end_kind") == "TYPE")
    second = second.withColumn(
        "type", F.last(F.when(F.col("_starts"), owner).when(ends, no_owner), ignorenulls=True).over(so_far)
    )
    outer, inner = F.col("outer"), F.col("inner")
    parent = F.when(inner["name"].isNotNull(), outer["name"])
    scope = F.coalesce(inner["name"], outer["name"])
    return second.select(
        "path", "line", "part", "text", "heads", "unit_kind", "unit_name", "end_kind", "declared", "calls", "case_of", "label",
        "moves", _text(F.col("section")).alias("section"), "in_type", "in_struct", F.col("_starts").alias("type_start"),
        F.when(F.col("in_type") & F.col("type.name").isNotNull(), F.col("type")).alias("type"),
        scope.alias("scope"), parent.alias("parent"), F.coalesce(inner["kind"], outer["kind"]).alias("scope_kind"),
        F.when(scope.isNotNull(), pou_id(F.col("path"), scope, parent)).alias("pou_id"),
    )


def pou_id(path: Column, name: Column, parent: Column) -> Column:
    """A child's id carries its parent, so equal method names in a file stay apart."""
    return F.concat(F.lit("st:"), path, F.lit(":"), F.when(parent.isNotNull(), F.concat(parent, F.lit("."), name)).otherwise(name))


def clauses(facts: DataFrame) -> DataFrame:
    """``(path, name, extends, implements)`` of headers, which may run over several lines; a name's last header counts."""
    heads = facts.filter("heads IS NOT NULL").select("path", F.posexplode("heads").alias("pos", "head"))
    part = lambda i: _text(F.regexp_extract("head", _CLAUSE, i))
    rows = heads.select(
        "path", "pos", part(1).alias("name"), part(2).alias("extends"),
        F.when(part(3).isNotNull(), F.split(part(3), r"\s*,\s*")).alias("implements"),
    ).filter("extends IS NOT NULL OR implements IS NOT NULL")
    return (
        rows.groupBy("path", "name").agg(F.max(F.struct("pos", "extends", "implements")).alias("c"))
        .select("path", "name", "c.extends", "c.implements")
    )


def extract(corpus: DataFrame, tasks: int | None = None) -> DataFrame:
    """The facts of a corpus; every table below is read off them.

    ``tasks`` is the number of tasks in which the facts of files meet; it has to grow with the corpus, or the share of one task does.
    Without it the session's setting counts.
    """
    facts = line_facts(segments(clean(corpus)))
    return with_scopes(facts.repartition(tasks, "path") if tasks else facts)


# ---- tables ----


def units(facts: DataFrame, now_ms: int | None = None) -> DataFrame:
    """Declared units with end line and header clauses."""
    any_kind = F.coalesce("unit_kind", "end_kind")
    outer = any_kind.isin(*OUTER_KINDS)
    inner = any_kind.isin(*INNER_KINDS)
    mark = F.struct("line", "end_kind")
    marks = facts.filter("unit_kind IS NOT NULL OR end_kind IS NOT NULL OR heads IS NOT NULL").select(
        "path", "line", "part", "unit_kind", "unit_name", "end_kind", "parent", "pou_id", "heads",
        F.when(outer, mark).alias("_outer"), F.when(outer | inner, mark).alias("_any"),
    )
    # the end belongs to the latest open unit of its level: the next mark of that level is looked at
    following = lambda c: F.expr(f"lead({c}) IGNORE NULLS OVER (PARTITION BY path ORDER BY line, part)")
    ended = F.when(outer, F.when(F.col("_next_outer.end_kind").isin(*OUTER_KINDS), F.col("_next_outer.line"))).when(
        F.col("_next_any.end_kind").isin(*INNER_KINDS), F.col("_next_any.line")
    )
    marks = marks.select("*", following("_outer").alias("_next_outer"), following("_any").alias("_next_any"))
    # the few rows of units and headers are written, so the texts behind them are read once
    marks = cut_lineage(marks.filter("unit_kind IS NOT NULL OR heads IS NOT NULL").select(
        "path", "line", "part", "unit_kind", "unit_name", "parent", "pou_id", "heads", ended.alias("end_line")
    ))
    rows = marks.filter("unit_kind IS NOT NULL")
    now = F.lit(now_ms).cast("bigint")
    # a repeated declaration keeps its first place
    once = rows.groupBy(F.col("pou_id").alias("id")).agg(
        F.min(F.struct("line", "part", "path", "unit_name", "unit_kind", "end_line", "parent")).alias("u")
    )
    named = once.select(
        "id", F.col("u.unit_name").alias("name"), F.col("u.unit_kind").alias("pou_type"), F.col("u.path").alias("file_path"),
        F.col("u.line").alias("start_line"), F.col("u.end_line").alias("end_line"), F.col("u.parent").alias("namespace"),
    )
    heads = clauses(marks).withColumnRenamed("path", "file_path")
    return named.join(heads, ["file_path", "name"], "left").select(
        "id", "name", "pou_type", "file_path", "start_line", "end_line", "namespace", "extends", "implements",
        F.lit(None).cast("string").alias("signature"), now.alias("created_at"), now.alias("updated_at"),
    )


def _var_type(declared: Column) -> Column:
    """The type of a declaration ``names : type := default``."""
    return F.regexp_replace(F.regexp_extract(F.regexp_extract(declared, _DECLARATION, 2), r"(?s)^(.*?)\s*(?::=|$)", 1), r"\s+$", "")


def _declared(rows: DataFrame) -> DataFrame:
    """One row per declared name, with type and default apart."""
    keep = [c for c in rows.columns if c != "declared"]
    one = rows.select(*keep, F.explode("declared").alias("d"))
    default = F.regexp_replace(F.regexp_extract(F.regexp_extract("d", _DECLARATION, 2), r"(?s):=\s*(.*)$", 1), r"\s+$", "")
    return one.select(
        *keep, F.explode(F.split(F.regexp_extract("d", _DECLARATION, 1), r"\s*,\s*")).alias("name"),
        _var_type(F.col("d")).alias("var_type"), _text(default).alias("default_value"),
    )


def variables(facts: DataFrame) -> DataFrame:
    rows = facts.filter("section IS NOT NULL AND pou_id IS NOT NULL AND NOT in_type AND size(declared) > 0")
    rows = _declared(rows.select("path", "line", "part", "pou_id", "section", "declared"))
    return (
        rows.groupBy(F.concat(F.lit("st:var:"), "pou_id", F.lit(":"), "name").alias("id"))
        .agg(F.min(F.struct("line", "part", "pou_id", "name", "section", "var_type", "default_value", "path")).alias("v"))
        .select(
            "id", "v.pou_id", "v.name", F.col("v.section").alias("direction"), "v.var_type", "v.default_value",
            F.col("v.line").alias("start_line"), F.lit(None).cast("int").alias("end_line"), F.col("v.path").alias("file_path"),
        )
    )


def global_lists(facts: DataFrame) -> DataFrame:
    """Variables of VAR_GLOBAL sections outside of any unit."""
    rows = facts.filter("section = 'VAR_GLOBAL' AND pou_id IS NULL AND NOT in_type AND size(declared) > 0")
    rows = _declared(rows.select("path", "line", "section", "declared"))
    return (
        rows.groupBy(F.concat(F.lit("st:list:"), "path", F.lit(":"), "name").alias("id"))
        .agg(F.min(F.struct("line", "path", "name", "section")).alias("v"))
        .select("id", F.col("v.path").alias("file_path"), "v.name", F.col("v.section").alias("direction"),
                F.col("v.line").alias("start_line"), F.lit(None).cast("int").alias("end_line"))
    )


def _type_id(path: str, name: str) -> Column:
    return F.concat(F.lit("st:type:"), F.col(path), F.lit(":"), F.col(name))


def types(facts: DataFrame, now_ms: int | None = None) -> DataFrame:
    """Types of TYPE blocks: STRUCT with fields, ENUM with values, any other as TYPE."""
    rows = facts.filter("in_type AND type IS NOT NULL")
    def named(d: Column) -> Column:
        names = F.split(F.regexp_extract(d, _DECLARATION, 1), r"\s*,\s*")
        return F.transform(names, lambda n: F.struct(n.alias("name"), _var_type(d).alias("type")))

    field = F.when(F.col("in_struct"), F.flatten(F.transform("declared", named)))
    blocks = rows.groupBy("path", F.col("type.name").alias("name"), F.col("type.line").alias("line")).agg(
        F.max("line").alias("last_line"),
        F.max(F.col("in_struct").cast("int")).alias("is_struct"),
        # a type's lines are a part of one file and so of one row of the corpus
        F.sort_array(F.collect_list(F.struct("line", "part", "text", field.alias("fields")))).alias("body"),
    )
    text = F.array_join(F.transform("body", lambda b: b["text"]), "\n")
    inner = F.regexp_extract(text, r"(?s):(?!=)\s*\((.*?)\)\s*(?:\w+\s*)?(?::=[^;]*)?;?", 1)
    values = F.filter(
        F.transform(F.split(inner, ","), lambda v: F.regexp_extract(v, rf"^\s*({NAME})", 1)), lambda v: v != ""
    )
    is_struct = F.col("is_struct") == 1
    is_enum = ~is_struct & (F.size(values) > 0) & text.rlike(r"(?s)^[^:]*:(?!=)\s*\(")
    fields = F.flatten(F.transform(F.filter("body", lambda b: b["fields"].isNotNull()), lambda b: b["fields"]))
    no_values, no_fields = F.array().cast("array<string>"), F.array().cast("array<struct<name:string,type:string>>")
    spec = F.struct(
        F.when(is_struct, "struct").when(is_enum, "enum").otherwise("alias").alias("kind"),
        F.when(is_enum, values).otherwise(no_values).alias("values"),
        F.when(is_struct, fields).otherwise(no_fields).alias("fields"),
    )
    full = blocks.select(
        _type_id("path", "name").alias("id"), "name",
        F.when(is_struct, "STRUCT").when(is_enum, "ENUM").otherwise("TYPE").alias("type_kind"),
        F.col("path").alias("file_path"), F.col("line").alias("start_line"), F.col("last_line").alias("end_line"),
        F.to_json(spec).alias("definition"), F.lit(now_ms).cast("bigint").alias("created_at"),
    )
    columns = [c for c in full.columns if c != "id"]
    return full.groupBy("id").agg(F.min_by(F.struct(*columns), "start_line").alias("t")).select("id", "t.*")


def fields(facts: DataFrame) -> DataFrame:
    rows = facts.filter("in_struct AND type IS NOT NULL AND size(declared) > 0").withColumn("owner", F.col("type.name"))
    rows = _declared(rows.select("path", "line", "part", "owner", "declared"))
    parent = _type_id("path", "owner")
    return (
        rows.groupBy(F.concat(F.lit("st:field:"), parent, F.lit(":"), "name").alias("id"))
        .agg(F.min(F.struct("line", "part", parent.alias("parent_type_id"), "name", "var_type", "default_value", "path")).alias("f"))
        .select(
            "id", "f.parent_type_id", "f.name", F.col("f.var_type").alias("field_type"), "f.default_value",
            F.col("f.line").alias("start_line"), F.lit(None).cast("int").alias("end_line"), F.col("f.path").alias("file_path"),
        )
    )


def call_sites(facts: DataFrame) -> DataFrame:
    """``(path, line, pou_id, scope, callee)``: names followed by a bracket, with the innermost unit around them.

    A name that starts a type block or declares a unit is no call, but a call may follow a header on its line; names that
    no unit bears drop out on resolution.
    """
    rows = facts.filter("pou_id IS NOT NULL AND size(calls) > 0")
    return rows.select("path", "line", "pou_id", "scope", "parent", F.explode("calls").alias("callee")).distinct()


def states(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """States and transitions of ``CASE selector OF`` blocks: ``(states, transitions)``.

    A label of the block is a state; an assignment to the selector inside a branch is a transition. Nested blocks are
    told apart by their depth, and an assignment counts for the innermost block around it.
    """
    rows = facts.filter("NOT in_type AND pou_id IS NOT NULL AND section IS NULL").filter(
        "label IS NOT NULL OR moves IS NOT NULL OR case_of IS NOT NULL OR end_kind = 'CASE'"
    )
    in_file = W.partitionBy("path").orderBy("line", "part").rowsBetween(W.unboundedPreceding, 0)
    opens, closes = F.col("case_of").isNotNull(), F.col("end_kind") == "CASE"
    depth = F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(in_file)
    rows = rows.withColumn("depth", depth)
    level = W.partitionBy("path", "depth").orderBy("line", "part").rowsBetween(W.unboundedPreceding, 0)
    block = F.struct(F.col("case_of").alias("selector"), "line", "part")
    rows = rows.withColumn("block", F.last(F.when(opens, block), ignorenulls=True).over(level)).filter(
        "depth > 0 AND block IS NOT NULL"
    )
    branch = W.partitionBy("path", "depth", "block").orderBy("line", "part").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("state", F.last("label", ignorenulls=True).over(branch))
    found_states = rows.filter("label IS NOT NULL AND label <> 'ELSE'").select(
        "path", "pou_id", F.col("block.selector").alias("selector"),
        F.explode(F.split("label", r"\s*,\s*")).alias("state"), "line",
    ).distinct()
    moves = rows.filter("state IS NOT NULL").select("path", "pou_id", "block", "state", "line", F.explode("moves").alias("a"))
    transitions = moves.filter(F.lower("a.var") == F.lower("block.selector")).select(
        "path", "pou_id", F.col("block.selector").alias("selector"),
        F.explode(F.split("state", r"\s*,\s*")).alias("from_state"), F.col("a.val").alias("to_state"), "line",
    )
    return found_states, transitions


def state_counts(found_states: DataFrame, transitions: DataFrame) -> DataFrame:
    per_unit = found_states.groupBy("pou_id").agg(F.count_distinct("selector", "state").alias("total_states"))
    moves = transitions.groupBy("pou_id").agg(F.count(F.lit(1)).alias("total_transitions"))
    return per_unit.join(moves, "pou_id", "left").fillna(0, ["total_transitions"])


def attribute_callers(sites: DataFrame, pous: DataFrame) -> DataFrame:
    """Sites ``(path, line, ...)`` with the innermost unit that covers them, for units that did not come from the text.

    Starts of units and sites of a file are walked in line order instead of being joined by range. Of the members and
    of the top units the latest start is the candidate, besides the latest unit without an end, which reaches to the
    end of the file; the candidate that covers the line and starts last is the innermost.
    """
    columns = sites.columns
    empty = F.lit(None)
    unit = F.struct(
        F.col("start_line").alias("from_line"), F.coalesce("end_line", F.lit(2**31 - 1)).alias("until"),
        F.col("id").alias("id"),
    )
    starts = pous.select(
        F.col("file_path").alias("path"), F.col("start_line").alias("line"), F.lit(0).alias("_order"), unit.alias("_unit"),
        F.col("namespace").isNotNull().alias("_member"), F.col("end_line").isNull().alias("_open"),
        *[empty.cast(f.dataType).alias(f.name) for f in sites.schema.fields if f.name not in ("path", "line")],
    )
    marks = starts.unionByName(sites.withColumn("_order", F.lit(1)), allowMissingColumns=True)
    so_far = W.partitionBy("path").orderBy("line", "_order").rowsBetween(W.unboundedPreceding, 0)
    last = lambda when: F.last(F.when(when, F.col("_unit")), ignorenulls=True).over(so_far)
    marks = marks.select(
        "*", last(F.col("_member")).alias("_a"), last(~F.col("_member")).alias("_b"), last(F.col("_open")).alias("_c")
    ).filter("_order = 1")
    covering = [F.when(F.col(f"{c}.until") >= F.col("line"), F.col(c)) for c in ("_a", "_b", "_c")]
    return marks.select(*columns, F.greatest(*covering)["id"].alias("pou_id")).filter("pou_id IS NOT NULL")
