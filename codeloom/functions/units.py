"""Sizes and durations for people."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ["KiB", "MiB", "GiB", "TiB", "PiB", "EiB"]
SECONDS = {"d": 86400.0, "h": 3600.0, "m": 60.0, "s": 1.0, "ms": 0.001}


def format_bytes(n: Column, units: Sequence[str] = UNITS) -> Column:
    """``512 B``, ``1.5 KiB``: steps of 1024, one decimal; the last of ``units`` goes on for all that is larger."""
    out = F.format_string("%d B", n)
    for k, unit in enumerate(units, 1):
        out = F.when(n >= 1024**k, F.format_string(f"%.1f {unit}", F.bround(n / float(1024**k), 1))).otherwise(out)
    return out


def parse_duration(s: str) -> float:
    """Seconds of ``30d``, ``1h30m``, ``500ms``."""
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|[dhms])", s.strip())
    if not parts or "".join(a + b for a, b in parts) != s.strip():
        raise ValueError(f"not a duration: {s!r}")
    return sum(float(a) * SECONDS[b] for a, b in parts)


def duration_seconds(text: Column) -> Column:
    """:func:`parse_duration` for a column; null for what isn't a duration."""
    parts = F.regexp_extract_all(text, F.lit(r"[0-9]+(?:[.][0-9]+)?(?:ms|[dhms])"), 0)

    def seconds(part: Column) -> Column:
        unit = F.regexp_extract(part, "[a-z]+$", 0)
        size = F.coalesce(*(F.when(unit == u, F.lit(v)) for u, v in SECONDS.items()))
        return F.regexp_extract(part, "^[0-9.]+", 0).cast("double") * size

    whole = (F.size(parts) > 0) & (F.array_join(parts, "") == F.regexp_replace(text, r"^\s+|\s+$", ""))
    return F.when(whole, F.aggregate(F.transform(parts, seconds), F.lit(0.0), lambda a, x: a + x))


def age_seconds(since: Column, now: Column | None = None) -> Column:
    return F.unix_timestamp(F.current_timestamp() if now is None else now) - F.unix_timestamp(since)
