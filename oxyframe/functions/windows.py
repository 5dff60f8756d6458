"""Rolling windows as SQL text, by samples (ROWS) or by time (RANGE).

Window expressions of one frame share their partition keys and order, so one
exchange and one sort serve every channel. A frame by time sorts by time alone, as
RANGE offsets allow one key.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SignalError

SERIES, ROW = "series", "_i"


def q(name: str) -> str:
    """A quoted identifier."""
    return "`" + name.replace("`", "``") + "`"


def clean(name: str) -> str:
    """The column as a double with NaN and infinities as null."""
    c = f"cast({q(name)} as double)"
    return f"case when isnan({c}) or abs({c}) = double('Infinity') then null else {c} end"


def _edge(x: float, unit: str = "") -> str:
    if x == 0:
        return "CURRENT ROW"
    return f"{abs(x)!r}{unit} {'PRECEDING' if x < 0 else 'FOLLOWING'}"


def offsets(width: int | None, span: float | None, align: str = "centre") -> tuple[float, float]:
    """Window bounds around a sample; width wins. An even centred width reaches one further forward."""
    align = {"center": "centre"}.get(align, align)
    if align not in ("centre", "left", "right"):
        raise SignalError("'align' must be centre, left or right")
    if width is not None:
        return {"centre": (-((width - 1) // 2), width // 2), "left": (0, width - 1), "right": (-(width - 1), 0)}[align]
    return {"centre": (-span / 2, span / 2), "left": (0.0, span), "right": (-span, 0.0)}[align]


def over(time: str, width: int | None = None, span: float | None = None, align: str = "centre", by: Sequence[str] = (SERIES,)) -> str:
    """The OVER clause of a rolling window."""
    keys = ", ".join(map(q, by))
    lo, hi = offsets(width, span, align)
    if width is not None:
        return f"(PARTITION BY {keys} ORDER BY {q(ROW)} ROWS BETWEEN {_edge(int(lo))} AND {_edge(int(hi))})"
    return f"(PARTITION BY {keys} ORDER BY {q(time)} RANGE BETWEEN {_edge(float(lo), 'D')} AND {_edge(float(hi), 'D')})"


def whole(by: Sequence[str] = (SERIES,)) -> str:
    return f"(PARTITION BY {', '.join(map(q, by))})"


def tied(time: str, by: Sequence[str] = (SERIES,)) -> str:
    """Rows of the same time. Partitioned by series alone, so that it needs no exchange of its own."""
    return f"(PARTITION BY {', '.join(map(q, by))} ORDER BY {q(time)} RANGE BETWEEN CURRENT ROW AND CURRENT ROW)"


def past(*order: str, by: Sequence[str] = (SERIES,)) -> str:
    """From the first row to this one. For the rows after this one reverse the order: a frame that reaches forward without end costs the square."""
    return f"(PARTITION BY {', '.join(map(q, by))} ORDER BY {', '.join(order)} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def least_samples(width: int | None, span: float | None, rate: str | float | None, floor: int = 1) -> str:
    """SQL of the number of samples of a complete window."""
    if width is not None:
        return str(max(width, floor))
    return f"greatest(floor({span!r}D * {rate}) - 2, {floor})"


def rolling_mean(x: str, frame: str, least: str = "1", skip_null: bool = False) -> str:
    """Mean of the finite values; null where the window has none, too few samples, or (unless skipped) a null."""
    some = f"count({x}) OVER {frame}"
    every = f"count(*) OVER {frame}"
    strict = "" if skip_null else f" or {some} < {every}"
    return f"case when {some} = 0 or {every} < {least}{strict} then null else avg({x}) OVER {frame} end"


def rolling_median(x: str, frame: str) -> str:
    return f"percentile({x}, 0.5) OVER {frame}"


def middle(sorted_array: str) -> str:
    """Median of a sorted array; null of an empty one."""
    return f"(get({sorted_array}, (size({sorted_array}) - 1) div 2) + get({sorted_array}, size({sorted_array}) div 2)) / 2"


# Rates that an estimate is snapped to.
RATES = (0.25, 0.5, 1, 2, 3, 4, 5, 10, 15, 20, 25, 30, 50, 60, 75, 100)


def snapped(rate: float | None) -> float:
    """The listed rate nearest to an estimate; the first of equals."""
    if rate is None or not math.isfinite(rate) or rate == 0:
        raise SignalError("sample rate cannot be estimated")
    return float(min(RATES, key=lambda r: abs(r - rate)))


def snapped_sql(rate: str) -> str:
    """SQL of the same."""
    listed = "array(" + ", ".join(f"{r!r}D" for r in map(float, RATES)) + ")"
    return f"get(transform(array_sort(transform({listed}, (_rate_of, _rank_of) -> struct(abs(_rate_of - {rate}) as d, _rank_of as k, _rate_of as r))), _best_of -> _best_of.r), 0)"


def halo(df: DataFrame, before: int, after: int, rows: int) -> DataFrame:
    """Cuts long series into chunks of ``rows`` samples with their neighbours' rows.

    Adds ``_chunk`` and ``_own``; windows by samples within (series, _chunk) are exact
    on own rows if they reach no further than ``before`` and ``after``. A series that
    holds a third of all rows then spreads over as many tasks as it has chunks.
    """
    i = F.col(ROW)
    first = F.floor((i - after) / rows)
    last = F.floor((i + before) / rows)
    return df.withColumn("_chunk", F.explode(F.sequence(F.greatest(first, F.lit(0)), last))).withColumn("_own", F.col("_chunk") == F.floor(i / rows))
