"""Cleaning: invalid values, local outliers, gaps.

All channels of one step are computed in one projection, so they share an exchange
and a sort by series.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import args as A
from ..errors import SignalError
from ..frame import ROW, SERIES, SignalFrame
from ..functions import windows as W

MAD_SCALE = 1.4826  # of a normal distribution's median absolute deviation
LEAST_STEP = 1e-5


def _with(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns replaced by SQL expressions, in place."""
    return df.select(*[F.expr(columns[c]).alias(c) if c in columns else F.col(W.q(c)) for c in df.columns], *[F.expr(e).alias(c) for c, e in columns.items() if c not in df.columns])


def _invalid(x: str, values: Sequence[float] | None, above: float | None, below: float | None) -> str:
    tests = []
    if values:
        tests.append(f"{x} in ({', '.join(f'{float(v)!r}D' for v in values)})")
    if above is not None:
        tests.append(f"{x} >= {float(above)!r}D")
    if below is not None:
        tests.append(f"{x} <= {float(below)!r}D")
    return f"coalesce({' or '.join(tests)}, false)"


def replace_invalid(sf: SignalFrame, channels: Any = None, time_channel: Any = None, invalid_values=None, invalid_above=None, invalid_below=None, width=None, span=None, method: str = "median", chunk_rows: int | None = None, verbose: bool = True) -> SignalFrame:
    """Listed values, and values at or beyond the limits, become null or (``median``) the window's median without them.

    ``chunk_rows`` cuts long series into chunks with overlap (width windows only).
    """
    func = "replace_invalid"
    names = sf.channel_names(channels, func)
    values = None if invalid_values is None else A.as_list(invalid_values)
    if values is None and invalid_above is None and invalid_below is None:
        raise SignalError("no replacement criteria specified", func)
    A.number("invalid_values", values, func=func)
    A.number("invalid_above", invalid_above, 1, func=func)
    A.number("invalid_below", invalid_below, 1, func=func)
    A.choice("method", method, ("median", "none"), func)
    bad = {c: _invalid(W.clean(c), values, invalid_above, invalid_below) for c in names}
    if method == "none":
        return sf._new(_with(sf.df, {c: f"case when {bad[c]} then null else {W.clean(c)} end" for c in names}), channels=names)
    width, span = A.width_span(width, span, func, verbose)
    time = sf.time_name(time_channel, func) if span is not None or time_channel or sf.meta.time_channel else ROW
    if span is not None:
        sf.check_sorted(time, func)
    by = (SERIES,)
    df = _with(sf.df, {f"_bad_{c}": bad[c] for c in names})
    df = _with(df, {c: f"case when {W.q('_bad_' + c)} then null else {W.clean(c)} end" for c in names})
    if chunk_rows and width is not None:
        lo, hi = W.offsets(width, None)
        df, by = W.halo(df, -int(lo), int(hi), chunk_rows), (SERIES, "_chunk")
    frame = W.over(time, width, span, by=by)
    df = _with(df, {c: f"case when {W.q('_bad_' + c)} then {W.rolling_median(W.q(c), frame)} else {W.q(c)} end" for c in names})
    if "_own" in df.columns:
        df = df.where("_own").drop("_own", "_chunk")
    return sf._new(df.drop(*[f"_bad_{c}" for c in names]), channels=names)


def replace_outliers(sf: SignalFrame, channels: Any = None, time_channel: Any = None, outlier_cutoff: float = 3, width=None, span=None, method: str = "median", verbose: bool = True) -> SignalFrame:
    """Hampel filter: local outliers become null or (``median``) their window's median."""
    func = "replace_outliers"
    names = sf.channel_names(channels, func)
    A.number("outlier_cutoff", outlier_cutoff, 1, 0, func=func)
    A.choice("method", method, ("median", "none"), func)
    width, span = A.width_span(width, span, func, verbose)
    time = sf.time_name(time_channel, func) if span is not None else ROW
    if span is not None:
        sf.check_sorted(time, func)
    df = sf.df
    frame = W.over(time, width, span)
    columns = df.columns
    step1, step2, step3, step4 = {}, {}, {}, {}
    for k, c in enumerate(names):
        x = W.q(c)
        step1[c] = W.clean(c)
        before = f"last({x}, true) OVER (PARTITION BY {SERIES} ORDER BY {ROW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        step2[f"_w{k}"] = f"array_sort(collect_list({x}) OVER {frame})"
        step2[f"_step{k}"] = f"abs({x} - {before})"
        step3[f"_least{k}"] = f"coalesce(min(case when _step{k} > {LEAST_STEP!r}D then _step{k} end) OVER {W.whole()}, double('Infinity'))"
        step3[f"_med{k}"] = W.middle(f"_w{k}")
        step4[f"_dev{k}"] = f"array_sort(transform(_w{k}, v -> abs(v - _med{k})))"
    final = {}
    for k, c in enumerate(names):
        x = W.q(c)
        out = f"abs({x} - _med{k}) > _least{k} and abs({x} - _med{k}) > {MAD_SCALE * float(outlier_cutoff)!r}D * {W.middle(f'_dev{k}')}"
        final[c] = f"case when {out} then {f'_med{k}' if method == 'median' else 'null'} else {x} end"
    for step in (step1, step2, step3, step4, final):
        df = _with(df, step)
    return sf._new(df.select(*map(W.q, columns)), channels=names)


def _tie_means(names: Sequence[str], time: str) -> dict[str, str]:
    """Mean of the values that share a time; null where all are null."""
    return {f"_v{k}": f"avg({W.clean(c)}) OVER {W.tied(time)}" for k, c in enumerate(names)}


def interpolate(x0: str, x1: str, time: str, method: str) -> str:
    """SQL of the value between two known (t, x) structs; beyond the ends the nearest known one."""
    if method == "locf":
        return f"coalesce({x0}.x, {x1}.x)"
    t = W.q(time)
    return (
        f"case when {x0} is null then {x1}.x when {x1} is null or {x0}.t = {t} or {x1}.t = {x0}.t then {x0}.x "
        f"else {x0}.x + ({x1}.x - {x0}.x) * ({t} - {x0}.t) / ({x1}.t - {x0}.t) end"
    )


def _fill(df: DataFrame, names: Sequence[str], time: str, method: str, by_time: bool = False) -> DataFrame:
    columns = df.columns
    t = W.q(time)
    if by_time:
        known = df.groupBy(F.col(SERIES).alias("_series"), F.col(t).alias("_time")).agg(*[F.expr(f"avg({W.clean(c)})").alias(f"_v{k}") for k, c in enumerate(names)])
        known = _known(known, range(len(names)), "_time", ["_time"], ("_series",)).drop(*[f"_v{k}" for k in range(len(names))])
        df = df.join(known, F.col(SERIES).eqNullSafe(F.col("_series")) & F.col(t).eqNullSafe(F.col("_time")))
    else:
        df = _known(_with(df, _tie_means(names, time)), range(len(names)), t, [t, ROW])
    df = _with(df, {c: interpolate(f"_a{k}", f"_b{k}", time, method) for k, c in enumerate(names)})
    return df.select(*map(W.q, columns))


def _known(df: DataFrame, channels: Sequence[int], t: str, order: Sequence[str], by: Sequence[str] = (SERIES,)) -> DataFrame:
    """The known (t, x) structs before (``_a``) and after (``_b``) each row, from ``_v``, where known its own in both."""
    known = {k: f"case when _v{k} is not null then named_struct('t', {t}, 'x', _v{k}) end" for k in channels}
    ahead, behind = W.past(*order, by=by), W.past(*[f"{x} DESC" for x in order], by=by)
    df = _with(df, {f"_a{k}": f"last({known[k]}, true) OVER {ahead}" for k in known})
    return _with(df, {f"_b{k}": f"last({known[k]}, true) OVER {behind}" for k in known})


def _neighbour_median(df: DataFrame, c: str, time: str, width: int | None, span: float | None) -> DataFrame:
    """Null values of one channel become the median of their valid neighbours."""
    x = W.q(c)
    df = _with(df, {c: W.clean(c)})
    if span is not None:
        known = f"case when {x} is not null then {x} end"
        df = _with(df, {
            "_m": W.rolling_median(x, W.over(time, None, span)),
            "_a": f"last({known}, true) OVER {W.past(ROW)}",
        })
        df = _with(df, {"_b": f"last({known}, true) OVER {W.past(f'{ROW} DESC')}"})
        both = "case when _a is null then _b when _b is null then _a else (_a + _b) / 2 end"
        return _with(df, {c: f"coalesce({x}, _m, {both})"}).drop("_m", "_a", "_b")
    k = max(1, width // 2)
    ranked = _with(df, {"_rank": f"count({x}) OVER {W.past(ROW)}"})
    valid = ranked.where(f"{x} is not null").selectExpr(SERIES, "_rank as _near", f"{x} as _x")
    asks = ranked.where(f"{x} is null").selectExpr(SERIES, ROW, f"explode(sequence(greatest(_rank - {k - 1}, 1), _rank + {k})) as _near")
    medians = asks.join(valid, [SERIES, "_near"]).groupBy(SERIES, ROW).agg(F.expr("percentile(_x, 0.5)").alias("_m"))
    joined = df.join(medians, [SERIES, ROW], "left")
    return joined.select(*[F.expr(f"coalesce({x}, _m)").alias(c) if n == c else F.col(W.q(n)) for n in df.columns])


def replace_missing(sf: SignalFrame, channels: Any = None, time_channel: Any = None, width=None, span=None, method: str = "linear", verbose: bool = True, by_time: bool = False) -> SignalFrame:
    """Nulls are interpolated, carried forward, or become the median of valid neighbours.

    ``linear`` and ``locf`` give rows of equal time their mean, and the ends the
    nearest value. A channel without values stays null. ``by_time`` is for few long
    series of many rows a time: a task then holds the distinct times of a series, not
    its rows, which are dealt out by time and joined to what is known of it (not ``median``).
    """
    func = "replace_missing"
    names = sf.channel_names(channels, func)
    time = sf.time_name(time_channel, func) if time_channel or sf.meta.time_channel else ROW
    A.choice("method", method, ("linear", "median", "locf"), func)
    if method != "median":
        return sf._new(_fill(sf.df, names, time, method, by_time), channels=names)
    width, span = A.width_span(width, span, func, verbose)
    if span is not None:
        sf.check_sorted(time, func)
    df = sf.df
    for c in names:
        df = _neighbour_median(df, c, time, width, span)
    return sf._new(df, channels=names)


def replace(sf: SignalFrame, channels: Any = None, time_channel: Any = None, invalid_values=None, invalid_above=None, invalid_below=None, outlier_cutoff=None, width=None, span=None, method: Any = "linear", verbose: bool = True) -> SignalFrame:
    """Invalid values, then outliers, become null; then nulls are filled. Every argument may differ by channel."""
    func = "replace"
    sf._need_columns(2, func)
    names = sf.channel_names(channels, func)
    time = sf.time_name(time_channel, func)
    per = A.per_channel(
        names,
        {"invalid_values": invalid_values, "invalid_above": invalid_above, "invalid_below": invalid_below, "outlier_cutoff": outlier_cutoff, "width": width, "span": span, "method": method},
        defaults={"method": "linear"},
        choices={"method": ("linear", "median", "locf", "none")},
        verbose=verbose,
        func=func,
    )
    limits = ("invalid_values", "invalid_above", "invalid_below")
    if all(a["method"] == "none" and a["outlier_cutoff"] is None and all(a[k] is None for k in limits) for a in per.values()):
        raise SignalError("no replacement criteria specified", func)
    for c in names:
        a = per[c]
        if a["outlier_cutoff"] is not None or a["method"] == "median":
            A.width_span(a["width"], a["span"], func, verbose and c == names[0])
    out = SignalFrame(sf.df, sf.meta, False, sf.lone)
    # Channels that ask for the same are done together.
    alike: dict[tuple, list[str]] = {}
    for c in names:
        alike.setdefault(tuple(map(repr, per[c].items())), []).append(c)
    if sf.checks and any(per[g[0]]["span"] is not None for g in alike.values()):
        sf.check_sorted(time, func)
    for group in alike.values():
        a = per[group[0]]
        if any(a[k] is not None for k in limits):
            out = replace_invalid(out, group, time, *(a[k] for k in limits), method="none")
        if a["outlier_cutoff"] is not None:
            out = replace_outliers(out, group, time, a["outlier_cutoff"], a["width"], a["span"], method="none", verbose=False)
        if a["method"] != "none":
            out = replace_missing(out, group, time, a["width"], a["span"], a["method"], verbose=False)
    return SignalFrame(out.df, sf.meta.with_(channels=names, time_channel=time), sf.checks, sf.lone)
