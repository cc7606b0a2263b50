"""Names that look like calls but are standard functions, function blocks or keywords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Standard blocks and functions, and control keywords.
STANDARD_NAMES = (
    "TON TOF TP TONR R_TRIG F_TRIG SR RS CTU CTD CTUD "
    "ABS SQRT LN LOG EXP SIN COS TAN ASIN ACOS ATAN ATAN2 ADD SUB MUL DIV MOD EXPT MOVE "
    "GT GE EQ LE LT NE AND OR XOR NOT SHL SHR ROL ROR SEL MAX MIN LIMIT MUX TRUNC ROUND "
    "LEN LEFT RIGHT MID CONCAT INSERT DELETE REPLACE FIND SIZEOF TYPE_OF REF ADR "
    "IF ELSIF WHILE FOR CASE RETURN THEN DO OF TO BY"
).split()

# Types with conversion functions among each other. Strings convert to no BOOL.
CONVERTED_TYPES = (
    "BOOL BYTE WORD DWORD SINT INT DINT LINT USINT UINT UDINT ULINT REAL LREAL STRING WSTRING"
).split()

# Conversions of dates and times.
TIME_CONVERSIONS = (
    "TIME_TO_STRING STRING_TO_TIME DATE_TO_STRING STRING_TO_DATE TOD_TO_STRING STRING_TO_TOD DT_TO_STRING STRING_TO_DT "
    "TIME_TO_LINT LINT_TO_TIME DATE_AND_TIME_TO_LINT LINT_TO_DATE_AND_TIME"
).split()

# Types of the language that no corpus declares.
ELEMENTARY_TYPES = CONVERTED_TYPES + (
    "LWORD TIME LTIME DATE LDATE TIME_OF_DAY TOD LTOD DATE_AND_TIME DT LDT CHAR WCHAR BIT ANY POINTER"
).split()

_TYPES = "|".join(CONVERTED_TYPES)
_CONVERSION = rf"^(?!(\w+)_TO_\1$)(?!W?STRING_TO_BOOL$)(?:{_TYPES})_TO_(?:{_TYPES})$"


def standard_names() -> Column:
    """The plain names as a constant array."""
    return F.split(F.lit(" ".join((*STANDARD_NAMES, *TIME_CONVERSIONS))), " ")


def is_conversion(name: Column) -> Column:
    return name.contains("_TO_") & name.rlike(_CONVERSION)


def is_standard(name: Column | str) -> Column:
    """Whether a name is on the list; the list is case-sensitive."""
    value = F.col(name) if isinstance(name, str) else name
    return F.array_contains(standard_names(), value) | is_conversion(value)


def is_elementary(name: Column | str) -> Column:
    """Whether a type name belongs to the language; such names are the most frequent ones and never lead to an edge."""
    value = F.col(name) if isinstance(name, str) else name
    return F.array_contains(F.split(F.lit(" ".join(ELEMENTARY_TYPES)), " "), F.upper(value))
