"""Environment files: lines to keys and values, and the state of a value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions.security import is_placeholder

# Names of environment files, and what is said about a value.
CANDIDATES = [".env", ".env.local", ".env.example", ".env.template", ".env.development", ".env.production"]
NOTE = "value matches placeholder pattern"
PLACEHOLDER_WARNING = " is a placeholder — likely causing authentication failures"
EMPTY_WARNING = " is empty — dependent features will fail"


def _trim(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def is_assignment(line: Column) -> Column:
    trimmed = _trim(line)
    return ~trimmed.startswith("#") & (F.locate("=", trimmed) > 0)


def key(line: Column) -> Column:
    return _trim(F.substring_index(_trim(line), "=", 1))


def value(line: Column) -> Column:
    """What follows the first ``=``, without one pair of equal quotes."""
    raw = _trim(F.regexp_extract(_trim(line), r"(?s)^[^=]*=(.*)$", 1))
    return F.regexp_replace(raw, r"""(?s)^"(.*)"$|^'(.*)'$""", "$1$2")


def state(value: Column) -> Column:
    return F.when(value == "", F.lit("empty")).when(is_placeholder(value), F.lit("placeholder")).otherwise(F.lit("set"))


def note(state: Column) -> Column:
    return F.when(state == "placeholder", F.lit(NOTE))


def warning(key: Column, state: Column) -> Column:
    return F.when(state == "placeholder", F.concat(key, F.lit(PLACEHOLDER_WARNING))).when(
        state == "empty", F.concat(key, F.lit(EMPTY_WARNING))
    )
