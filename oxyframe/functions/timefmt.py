"""Time as people write it: h:mm:ss text and axis breaks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNITS = {"secs": 1, "mins": 60, "hours": 3600, "days": 86400, "weeks": 604800}
# Ranges in seconds up to which an axis counts in seconds, minutes, hours, days, and the steps it takes, in seconds.
STEPS = (
    (5 * 60, (1, 2, 5, 10, 15, 20, 30, 60, 120)),
    (5 * 3600, (60, 120, 300, 600, 900, 1200, 1800, 3600, 7200)),
    (5 * 86400, (900, 1800, 3600, 7200, 10800, 14400, 21600, 28800, 43200, 86400)),
    (math.inf, (86400, 604800, 2419200)),
)


def format_hmmss(seconds: Sequence[float | None]) -> list[str | None]:
    """``mm:ss``, or ``h:mm:ss`` if any reaches an hour; hundredths if any has a fraction. None and NaN stay."""
    known = [x for x in seconds if x is not None and not math.isnan(x)]
    hours = any(abs(x) >= 3600 for x in known)
    parts = any(x != math.floor(x) for x in known)
    out: list[str | None] = []
    for x in seconds:
        if x is None or math.isnan(x):
            out.append(None)
            continue
        a = abs(x)
        h, m, s = int(a // 3600), int(a % 3600 // 60), a % 60
        tail = f"{s:05.2f}" if parts else f"{int(s):02d}"
        out.append(("-" if x < 0 else "") + (f"{h}:{m:02d}:{tail}" if hours else f"{int(a // 60):02d}:{tail}"))
    return out


def with_hmmss(df: DataFrame, x: str, name: str) -> DataFrame:
    """``df`` with the same of column ``x``; what the whole column has is one aggregated row, joined by broadcast."""
    q = f"`{x}`"
    every = df.agg(F.expr(f"coalesce(max(abs({q}) >= 3600), false)").alias("_hours"), F.expr(f"coalesce(max({q} <> floor({q})), false)").alias("_parts"))
    s = f"case when _parts then format_string('%05.2f', abs({q}) % 60) else format_string('%02d', cast(floor(abs({q}) % 60) as int)) end"
    h = f"format_string('%d:%02d:', cast(floor(abs({q}) / 3600) as int), cast(floor(abs({q}) % 3600 / 60) as int))"
    m = f"format_string('%02d:', cast(floor(abs({q}) / 60) as int))"
    text = f"case when {q} is null or isnan({q}) then null else concat(case when {q} < 0 then '-' else '' end, case when _hours then {h} else {m} end, {s}) end"
    return df.join(F.broadcast(every)).withColumn(name, F.expr(text)).drop("_hours", "_parts")


def breaks_timespan(low: float, high: float, unit: str = "secs", n: int = 5) -> list[float]:
    """Axis breaks, in seconds, over a range given in ``unit``: whole steps of the usual length nearest to an n-th of it."""
    lo, hi = low * UNITS[unit], high * UNITS[unit]
    steps = next(s for most, s in STEPS if hi - lo <= most)
    step = min(steps, key=lambda s: abs(s - (hi - lo) / n))
    return [float(k * step) for k in range(math.floor(lo / step), math.ceil(hi / step) + 1)]
