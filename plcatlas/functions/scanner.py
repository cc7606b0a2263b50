"""Comment removal for Structured Text.

Block comments nest, which no regular expression can follow, so this is the one Python function of the corpus job. It
runs on Arrow batches and sees only files that hold a comment at all.
"""

from __future__ import annotations

import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# the executors get this module with the function, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

COMMENTS = T.ArrayType(T.StructType([T.StructField("line", T.IntegerType()), T.StructField("text", T.StringType())]))

# a string literal (a doubled quote stays inside it), a line comment, a block opener, a pragma that is no attribute
_TOKEN = re.compile(r"""'(?:[^']|'')*'?|"(?:[^"]|"")*"?|//[^\n]*|\(\*|\{(?!attribute)[^}]*\}?""")
_BLOCK = re.compile(r"\(\*|\*\)")


def scan(code: str) -> tuple[str, list[tuple[int, str]]]:
    """The text without comments but with all its line breaks, and the comments with their first lines."""
    kept, comments = [], []
    done = 0
    line, counted = 1, 0
    token = _TOKEN.search(code)
    while token:
        start, end = token.span()
        first = code[start]
        if first in "'\"":
            token = _TOKEN.search(code, end)
            continue
        kept.append(code[done:start])
        line += code.count("\n", counted, start)
        counted = start
        if first == "/":
            comments.append((line, code[start + 2 : end].strip()))
        else:
            if first == "(":
                body, end = _block(code, end)
                comments.append((line, body.strip()))
            kept.append("\n" * code.count("\n", start, end) or " ")
        done = end
        token = _TOKEN.search(code, end)
    kept.append(code[done:])
    return "".join(kept), comments


def _block(code: str, pos: int) -> tuple[str, int]:
    """Body of a block comment whose opener ends at ``pos``, without inner delimiters, and where it ends."""
    depth, parts = 1, []
    while depth:
        mark = _BLOCK.search(code, pos)
        if mark is None:
            parts.append(code[pos:])
            return "".join(parts), len(code)
        parts.append(code[pos : mark.start()])
        depth += 1 if mark.group() == "(*" else -1
        pos = mark.end()
    return "".join(parts), pos


@F.pandas_udf(T.StringType())
def _strip_batch(code: pd.Series) -> pd.Series:
    return code.map(lambda c: None if c is None else scan(c)[0])


@F.pandas_udf(COMMENTS)
def _comment_batch(code: pd.Series) -> pd.Series:
    return code.map(lambda c: None if c is None else [{"line": n, "text": t} for n, t in scan(c)[1]])


def _marked(content: Column) -> Column:
    """The text if it may hold a comment; all other files pass the Python function by as nulls."""
    return F.when(content.contains("//") | content.contains("(*") | content.contains("{"), content)


def stripped(content: Column) -> Column:
    """The text without comments."""
    return F.coalesce(_strip_batch(_marked(content)), content)


def harvested(content: Column) -> Column:
    """The comments of a text."""
    return F.coalesce(_comment_batch(_marked(content)), F.array().cast(COMMENTS))
