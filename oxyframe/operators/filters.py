"""Smoothing: moving average (windows), Butterworth and smoothing spline (Arrow kernels)."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import args as A
from ..errors import SignalError, inform, warn
from ..frame import ROW, SERIES, SignalFrame, each_rate
from ..functions import windows as W
from ..session import ship
from . import kernels
from .replace import _with

METHODS = ("smooth_spline", "butterworth", "moving_average")
_ALIASES = ((r"(?i)^(ma|moving[ _-]average)$", "moving_average"), (r"(?i)^(spline|smooth[ _-]spline)$", "smooth_spline"), (r"(?i)^butter(worth)?$", "butterworth"))
TYPES = ("low", "high", "stop", "pass")
EDGES = ("rev", "rep1", "none")


def method_name(name: Any) -> Any:
    if isinstance(name, dict):
        return {k: method_name(v) for k, v in name.items()}
    return next((full for pattern, full in _ALIASES if isinstance(name, str) and re.match(pattern, name)), name)


def _has_null(sf: SignalFrame, names: list[str]) -> list[str]:
    row = sf.df.agg(*[F.expr(f"count(*) - count({W.clean(c)})") for c in names]).first()
    return [c for c, n in zip(names, row, strict=True) if n]


def moving_average(sf: SignalFrame, channels: Any = None, time_channel: Any = None, width=None, span=None, partial: bool = False, skip_null: bool = False, align: str = "centre", chunk_rows: int | None = None, verbose: bool = True) -> SignalFrame:
    """Mean of each sample's window.

    Unless ``partial``, windows with fewer samples than a whole one give null; unless
    ``skip_null``, so do windows with a null. ``chunk_rows`` cuts long series into
    chunks with overlap (width windows only).
    """
    func = "moving_average"
    names = sf.channel_names(channels, func)
    width, span = A.width_span(width, span, func, verbose)
    time = sf.time_name(time_channel, func) if span is not None else ROW
    if sf.checks and verbose and not skip_null and (holes := _has_null(sf, names)):
        warn(f"channel(s) {', '.join(holes)} contain nulls; 'skip_null' ignores them", func)
    df, columns, by = sf.df, sf.df.columns, (SERIES,)
    if span is not None:
        sf.check_sorted(time, func)
        if not partial:
            t = W.q(time)
            df = _with(df, {"_step": f"{t} - lag({t}) OVER (PARTITION BY {SERIES} ORDER BY {ROW})"})
            df = _with(df, {"_rate": f"1 / percentile(_step, 0.5) OVER {W.whole()}"})
            df = _with(df, {"_rate": W.snapped_sql("_rate")})
    elif chunk_rows:
        lo, hi = W.offsets(width, None, align)
        df, by = W.halo(df, -int(lo), int(hi), chunk_rows), (SERIES, "_chunk")
    least = "1" if partial else W.least_samples(width, span, "_rate")
    if sf.checks and not partial:
        need = f"max({least})" if "_rate" in least else least
        short = df.groupBy(SERIES).agg(*[F.expr(f"count({W.clean(c)}) < {need}").alias(c) for c in names])
        if not short.where(" or ".join(map(W.q, names))).isEmpty():
            raise SignalError("insufficient valid samples: the window must be smaller than the series", func)
    df = _with(df, {c: W.clean(c) for c in names})
    frame = W.over(time, width, span, align, by)
    df = _with(df, {c: W.rolling_mean(W.q(c), frame, least, skip_null) for c in names})
    if "_own" in df.columns:
        df = df.where("_own")
    return sf._new(df.select(*map(W.q, columns)), channels=names)


def local_fun(sf: SignalFrame, channels: Any = None, fun: Any = "avg", time_channel: Any = None, width=None, span=None, align: str = "centre", verbose: bool = True) -> SignalFrame:
    """``fun`` of the finite values in each sample's window: the name of a SQL aggregate, or a function from a list to a number.

    A function runs in Python workers, by Arrow batches of windows; a window without values gives null.
    """
    func = "local_fun"
    names = sf.channel_names(channels, func)
    width, span = A.width_span(width, span, func, verbose)
    time = sf.time_name(time_channel, func) if span is not None else ROW
    df = _with(sf.df, {c: W.clean(c) for c in names})
    frame = W.over(time, width, span, align)
    if isinstance(fun, str):
        if not re.fullmatch(r"[A-Za-z_]+", fun):
            raise SignalError(f"'fun' must name a SQL aggregate, not {fun!r}", func)
        df = _with(df, {c: f"cast({fun}({W.q(c)}) OVER {frame} as double)" for c in names})
    else:
        ship(sf.df.sparkSession)

        @F.pandas_udf("double")
        def apply(windows: pd.Series) -> pd.Series:
            return windows.map(lambda w: float(fun(list(w))) if len(w) else None)

        df = _with(df, {c: f"collect_list({W.q(c)}) OVER {frame}" for c in names})
        df = df.select(*[apply(F.col(W.q(c))).alias(c) if c in names else F.col(W.q(c)) for c in df.columns])
    return sf._new(df.select(*map(W.q, sf.df.columns)), channels=names)


TOGETHER = 1 << 17  # rows of whole series that a task takes at once; a longer series is taken by itself


def _whole_series(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows that lie together by series, as tables of whole series and where each begins and ends."""
    held: list[pa.RecordBatch] = []
    n, tail = 0, None
    for batch in itertools.chain(batches, [None]):
        if batch is not None and not batch.num_rows:
            continue
        if batch is not None:
            first, last = batch.column(SERIES)[0].as_py(), batch.column(SERIES)[-1].as_py()
            # A series that goes on needs no search for its end.
            if not held or n < rows or first == last == tail:
                held.append(batch)
                n, tail = n + batch.num_rows, last
                continue
        if held:
            table = pa.Table.from_batches(held)
            key = table.column(SERIES).combine_chunks()
            new = pc.not_equal(key[1:], key[:-1])
            # A missing name is a series of its own.
            odd = pc.not_equal(pc.is_null(key[1:]), pc.is_null(key[:-1]))
            edge = np.flatnonzero(pc.or_(pc.fill_null(new, False), odd).to_numpy(zero_copy_only=False)) + 1
            edge = np.concatenate(([0], edge, [len(key)]))
            held, n = [], 0
            if batch is not None and tail == first:
                # The last series goes on in this batch.
                held, n = table.slice(int(edge[-2])).to_batches(), len(key) - int(edge[-2])
                table, edge = table.slice(0, int(edge[-2])), edge[:-1]
            if len(edge) > 1:
                yield table, edge
        if batch is not None:
            held.append(batch)
            n, tail = n + batch.num_rows, last


def _kernel(sf: SignalFrame, time: str, plans: dict[str, tuple]) -> SignalFrame:
    """One pass over the series for all channels that need a kernel.

    A series goes to one task whole, as recursion and global fits need it. Short ones are
    taken together: by themselves each costs more than its fit.
    """
    ship(sf.df.sparkSession)
    names = list(plans)
    columns = sf.df.columns
    schema = T.StructType([T.StructField(f.name, T.DoubleType()) if f.name in names else f for f in sf.df.schema.fields])
    df = _with(sf.df, {c: W.clean(c) for c in names})

    def numbers(table: pa.Table, c: str) -> np.ndarray:
        return table.column(c).cast(pa.float64(), safe=False).to_numpy().astype(float)

    def run(batches):
        for table, edge in _whole_series(batches, TOGETHER):
            t = numbers(table, time)
            for c, (kind, *a) in plans.items():
                x = numbers(table, c)
                ok = np.isfinite(x)
                places = [i + np.flatnonzero(ok[i:j]) for i, j in itertools.pairwise(edge.tolist())]
                places = [p for p in places if len(p)]
                if kind == "butterworth":
                    fits = kernels.filtered([x[p] for p in places], *a)
                else:
                    fits = kernels.smoothed([(t[p], x[p]) for p in places], a[0])
                y = np.full(len(x), np.nan)
                for p, fit in zip(places, fits, strict=True):
                    y[p] = fit
                k = table.schema.get_field_index(c)
                table = table.set_column(k, table.schema.field(k), pa.array(y, mask=~np.isfinite(y)))
            yield from table.to_batches(max_chunksize=1 << 14)

    out = df.repartition(SERIES).sortWithinPartitions(SERIES, ROW).mapInArrow(run, schema)
    return sf._new(out.select(*map(W.q, columns)), channels=names)


def butterworth_plan(order: int, cutoff: Any, kind: str, edges: str, steady: bool = False, func: str = "butterworth") -> tuple:
    A.number("order", order, 1, 1, whole=True, func=func)
    A.choice("type", kind, TYPES, func)
    A.choice("edges", edges, EDGES, func)
    A.number("W", cutoff, 1 if kind in ("low", "high") else 2, 0, 1, inclusive=False, func=func)
    return ("butterworth", *kernels.butterworth(int(order), cutoff, kind), edges, steady)


def butterworth(sf: SignalFrame, channels: Any = None, order: int = 2, W_: Any = None, type: str = "low", edges: str = "rev", skip_null: bool = False, steady: bool = False) -> SignalFrame:  # noqa: A002
    """Zero-phase Butterworth filter at ``W_`` of the Nyquist frequency."""
    func = "butterworth"
    names = sf.channel_names(channels, func)
    plan = butterworth_plan(order, W_, type, edges, steady, func)
    _no_nulls(sf, names, skip_null, func)
    return _kernel(sf, sf.meta.time_channel or ROW, dict.fromkeys(names, plan))


def smooth_spline(sf: SignalFrame, channels: Any = None, time_channel: Any = None, spar: float | None = None, skip_null: bool = False) -> SignalFrame:
    """Cubic smoothing spline; without ``spar`` each series' smoothness is cross-validated."""
    func = "smooth_spline"
    names = sf.channel_names(channels, func)
    time = sf.time_name(time_channel, func)
    A.number("spar", spar, 1, 0, inclusive=(False, True), func=func)
    _distinct_times(sf, time, func)
    _no_nulls(sf, names, skip_null, func)
    return _kernel(sf, time, dict.fromkeys(names, ("spline", spar)))


def _no_nulls(sf: SignalFrame, names: list[str], skip_null: bool, func: str) -> None:
    if sf.checks and not skip_null and (holes := _has_null(sf, names)):
        raise SignalError(f"channel(s) {', '.join(holes)} contain nulls; 'skip_null' ignores them", func)


def _distinct_times(sf: SignalFrame, time: str, func: str) -> None:
    if sf.checks and not sf.df.groupBy(SERIES, W.q(time)).count().where("count > 1").isEmpty():
        raise SignalError("time has repeated samples; resample first", func)


@each_rate
def filter_channels(
    sf: SignalFrame,
    channels: Any = None,
    time_channel: Any = None,
    method: Any = "smooth_spline",
    skip_null: bool = False,
    verbose: bool = True,
    spar: Any = None,
    order: Any = 2,
    W_: Any = None,
    fc: Any = None,
    sample_rate: float | None = None,
    type: Any = "low",  # noqa: A002
    edges: Any = "rev",
    width: Any = None,
    span: Any = None,
    partial: Any = False,
    steady: bool = False,
) -> SignalFrame:
    """Smooths each channel by its method; every argument may differ by channel.

    A Butterworth cutoff is ``W_`` (share of the Nyquist frequency) or ``fc`` (per time
    unit); ``W_`` wins.
    """
    func = "filter"
    sf._need_columns(2, func)
    names = sf.channel_names(channels, func)
    time = sf.time_name(time_channel, func)
    per = A.per_channel(
        names,
        {"method": method_name(method), "spar": spar, "order": order, "W": W_, "fc": fc, "type": type, "edges": edges, "width": width, "span": span, "partial": partial},
        {"method": "smooth_spline", "order": 2, "type": "low", "edges": "rev", "partial": False},
        {"method": METHODS, "type": TYPES, "edges": EDGES},
        verbose=verbose,
        func=func,
    )
    by = {m: [c for c in names if per[c]["method"] == m] for m in METHODS}
    rate = None
    if by["smooth_spline"]:
        _distinct_times(sf, time, func)
    if by["butterworth"]:
        rate = sf.rate(sample_rate, time, verbose, func)
    plans: dict[str, tuple] = {}
    for c in by["smooth_spline"]:
        A.number("spar", per[c]["spar"], 1, 0, inclusive=(False, True), func=func)
        plans[c] = ("spline", per[c]["spar"])
    for c in by["butterworth"]:
        a = per[c]
        if a["W"] is None and a["fc"] is None:
            raise SignalError("cutoff frequency undefined: give 'W_' or 'fc'", func)
        A.number("fc", a["fc"], 1 if a["type"] in ("low", "high") else 2, 0, inclusive=False, func=func)
        if a["W"] is not None and a["fc"] is not None:
            inform("'W_' overrides 'fc'", func, verbose and c == by["butterworth"][0])
        cutoff = a["W"]
        if cutoff is None:
            cutoff = [f / (rate / 2) for f in A.as_list(a["fc"])]
            if any(w > 1 or w <= 0 for w in cutoff):
                raise SignalError(f"'fc' must be between 0 and half the sample rate ({rate / 2:g} Hz)", func)
            cutoff = cutoff[0] if len(cutoff) == 1 else cutoff
        plans[c] = butterworth_plan(a["order"], cutoff, a["type"], a["edges"], steady, func)
    out = SignalFrame(sf.df, sf.meta, False, sf.lone)
    if plans:
        _no_nulls(sf, list(plans), skip_null, func)
        out = _kernel(out, time, plans)
    alike: dict[tuple, list[str]] = {}
    for c in by["moving_average"]:
        alike.setdefault((per[c]["width"], per[c]["span"], per[c]["partial"]), []).append(c)
    for (width, span, partial), group in alike.items():
        out.checks = sf.checks
        out = moving_average(out, group, time, width, span, partial, skip_null, verbose=verbose)
    return SignalFrame(out.df, sf.meta.with_(channels=names, time_channel=time, sample_rate=rate), sf.checks, sf.lone)
