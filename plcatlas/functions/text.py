"""Column expressions used across the jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plcatlas.schemas import DEFINITION

# Symbol kinds of the language server protocol and the entity type each one stands for.
SYMBOL_KINDS = {
    2: "PROGRAM",
    5: "FUNCTION_BLOCK",
    6: "METHOD",
    7: "PROPERTY",
    8: "VARIABLE",
    10: "ENUM",
    11: "INTERFACE",
    12: "FUNCTION",
    13: "VARIABLE",
    22: "ENUM_MEMBER",
    23: "TYPE",
}

# Severities of the language server protocol.
SEVERITIES = {1: "error", 2: "warning", 3: "info", 4: "hint"}

# Fixed value: length at which a call's arguments are cut in the event log.
ARGS_PREVIEW_CHARS = 200


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def slugify(name: Column | str) -> Column:
    """Letters, digits and underscores only; runs collapse to one, one is trimmed at either end."""
    collapsed = F.regexp_replace(F.regexp_replace(_col(name), "[^A-Za-z0-9_]", "_"), "_+", "_")
    return F.regexp_replace(collapsed, "^_|_$", "")


def wikilink(name: Column | str, file: Column | str | None = None) -> Column:
    slug = slugify(name)
    bare = F.concat(F.lit("[["), slug, F.lit("]]"))
    if file is None:
        return bare
    path = _col(file)
    named = F.concat(F.lit("[["), slug, F.lit("|"), path, F.lit("]]"))
    return F.when(path.isNull() | (path == ""), bare).otherwise(named)


def mermaid_id(name: Column | str) -> Column:
    return F.regexp_replace(_col(name), "[^A-Za-z0-9_]", "_")


def args_preview(args: Column | str, is_json: bool = True) -> Column:
    """The arguments as text (structured ones as JSON), cut with an ellipsis; null becomes ``{}``."""
    value = _col(args)
    text = F.coalesce(value if is_json else F.to_json(value), F.lit("{}"))
    return F.when(
        F.length(text) > ARGS_PREVIEW_CHARS, F.concat(F.substring(text, 1, ARGS_PREVIEW_CHARS), F.lit("…"))
    ).otherwise(text)


def iso_time(epoch_ms: Column | str) -> Column:
    return F.date_format(F.timestamp_millis(_col(epoch_ms)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def definition(json: Column | str) -> Column:
    """A type definition as a struct; unreadable text gives null members."""
    return F.from_json(_col(json), DEFINITION)


def definition_size(json: Column | str) -> Column:
    parsed = definition(json)
    return F.coalesce(F.array_size(parsed["fields"]), F.array_size(parsed["values"]), F.lit(0))


def half_up(value: Column | str, digits: int = 0) -> Column:
    """Round half towards plus infinity on the binary value, not on its decimal text."""
    scale = float(10**digits)
    return F.floor(_col(value) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def kind_to_type(kind: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SYMBOL_KINDS.items() for x in pair])
    return F.element_at(table, _col(kind).cast("int"))


def severity_label(severity: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SEVERITIES.items() for x in pair])
    return F.coalesce(F.element_at(table, _col(severity).cast("int")), F.lit("info"))


def clean_name(name: Column | str) -> Column:
    """``FB_X (FUNCTION_BLOCK)`` -> ``FB_X``."""
    return F.substring_index(_col(name), " (", 1)


def infer_type(raw_name: Column | str) -> Column:
    """Entity type by naming convention, then by a keyword in the uncut name."""
    raw = _col(raw_name)
    base = clean_name(raw)
    return (
        F.when(base.startswith("FB_"), "FUNCTION_BLOCK")
        .when(base.startswith("PRG_"), "PROGRAM")
        .when(base.startswith("FC_"), "FUNCTION")
        .when(base.startswith("E_"), "ENUM")
        .when(base.endswith("_STRUCT"), "TYPE")
        .when(raw.contains("FUNCTION_BLOCK"), "FUNCTION_BLOCK")
        .when(raw.contains("PROGRAM"), "PROGRAM")
        .when(raw.contains("FUNCTION"), "FUNCTION")
        .when(raw.contains("ENUM"), "ENUM")
        .when(raw.contains("STRUCT"), "TYPE")
    )


def relative_path(path: Column | str, workspace: str) -> Column:
    """Path below the workspace, with forward slashes; paths outside it are left alone."""
    value = _col(path)
    forward = F.translate(value, "\\", "/")
    root = workspace.replace("\\", "/") + "/"
    return F.when(forward.startswith(root), F.substr(forward, F.lit(len(root) + 1))).otherwise(value)


def matches(value: Column | str, query: str, case_sensitive: bool = False, regex: bool = False) -> Column:
    """Name search: a query holding a LIKE wildcard is the pattern, any other is looked for as a substring."""
    target = _col(value)
    if regex:
        return target.rlike(query if case_sensitive else f"(?i){query}")
    pattern = _escape(query if ("%" in query or "_" in query) else f"%{query}%")
    return target.like(pattern) if case_sensitive else target.ilike(pattern)


def contains_text(value: Column | str, text: str) -> Column:
    """Substring search that always wraps the text; ``%`` and ``_`` keep their LIKE meaning."""
    return _col(value).ilike(_escape(f"%{text}%"))


def _escape(pattern: str) -> str:
    """A backslash is an ordinary character in the search patterns, but an escape in Spark's LIKE."""
    return pattern.replace("\\", "\\\\")
