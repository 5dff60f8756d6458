"""Trailing windows and threshold replacement on streams.

Zero-phase filters, splines and centred windows need the future and are batch only.
State holds the last ``width`` samples of a series, whatever the stream's length.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..args import number
from ..functions import windows as W
from ..operators.replace import _invalid


def invalid_to_null(df: DataFrame, channels: list[str], values: Any = None, above: float | None = None, below: float | None = None) -> DataFrame:
    """Listed values, and values at or beyond the limits, become null."""
    listed = None if values is None else list(values)
    return df.withColumns({c: F.expr(f"case when {_invalid(W.clean(c), listed, above, below)} then null else {W.clean(c)} end") for c in channels})


def trailing_mean(df: DataFrame, series: str, time: str, channel: str, width: int) -> DataFrame:
    """series, time, value, mean of the last ``width`` samples, as rows arrive (by time within a batch).

    Nulls take a place but do not count; a series' first samples have shorter windows.
    """
    number("width", width, 1, 1, whole=True, func="trailing_mean")

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches), ignore_index=True).sort_values("time", kind="stable")
        means = []
        for x in rows["value"]:
            last = [*last, None if pd.isna(x) else float(x)][-width:]
            known = [v for v in last if v is not None]
            means.append(sum(known) / len(known) if known else None)
        state.update((last,))
        yield pd.DataFrame({"series": key[0], "time": rows["time"].to_numpy(), "value": rows["value"].to_numpy(), "mean": means})

    src = df.select(F.col(W.q(series)).cast("string").alias("series"), F.col(W.q(time)).cast("double").alias("time"), F.expr(W.clean(channel)).alias("value"))
    return src.groupBy("series").applyInPandasWithState(run, "series string, time double, value double, mean double", "last array<double>", "append", "NoTimeout")


def windowed_mean(df: DataFrame, series: str, stamp: str, channel: str, length: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Means of event-time windows, emitted once no later row can come (watermark ``late``)."""
    window = F.window(stamp, length, slide) if slide else F.window(stamp, length)
    grouped = df.withWatermark(stamp, late).groupBy(F.col(W.q(series)).alias("series"), window)
    return grouped.agg(F.expr(f"avg({W.clean(channel)})").alias("mean"), F.count("*").alias("n")).selectExpr("series", "window.start as begin", "window.end as end", "mean", "n")
