"""Resampling onto an even grid.

Source rows and grid rows are joined by a union and two windows (from the past, and
from the future by the reversed order), never by a range join.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import args as A
from ..errors import inform
from ..frame import ROW, SERIES, SignalFrame, each_rate
from ..functions import windows as W
from .replace import interpolate


def grid(sf: SignalFrame, time: str, rate: float):
    """series, _lo, _n (last index), _count (source rows): the even grid of each series."""
    t, r = W.q(time), f"{float(rate)!r}D"
    ends = sf.df.groupBy(SERIES).agg(F.min(t).alias("lo"), F.max(t).alias("hi"), F.count("*").alias("_count"))
    edge = ends.selectExpr(SERIES, f"floor(lo * {r}) / {r} as _lo", f"bround(hi * {r}, 0) / {r} as _hi", "_count").where("_lo is not null")
    return edge.selectExpr(SERIES, "_lo", f"cast(floor((_hi - _lo) * {r} + 1e-10) as bigint) as _n", "_count").where("_n >= 0")


@each_rate
def resample(sf: SignalFrame, time_channel: Any = None, sample_rate: float | None = None, resample_rate: float | None = None, method: str = "none", verbose: bool = True) -> SignalFrame:
    """Values on a grid of ``resample_rate`` per time unit.

    ``none`` takes the nearest sample within half a step (the earlier of two as near),
    ``linear`` and ``locf`` fill doubles; other columns are taken as they stood (when
    the grid is finer) or as the first value in each step (when it is coarser).
    """
    func = "resample"
    sf._need_columns(2, func)
    time = sf.time_name(time_channel, func)
    A.choice("method", method, ("none", "linear", "locf"), func)
    A.number("resample_rate", resample_rate, 1, 0, inclusive=(False, True), func=func)
    rate = sf.rate(sample_rate, time, verbose, func) if resample_rate is None or sf.meta.sample_rate is None and sample_rate is not None else None
    rate = float(resample_rate if resample_rate is not None else rate)
    sf.check_sorted(time, func)
    t = W.q(time)
    columns = [c for c in sf.data_columns if c != time]
    kinds = {c: sf.df.schema[c].dataType for c in columns}
    numeric = [c for c in columns if isinstance(kinds[c], (T.DoubleType, T.FloatType, T.DecimalType))] if method != "none" else []
    others = [c for c in columns if c not in numeric]

    g = grid(sf, time, rate)
    points = g.selectExpr(SERIES, "_lo", "_n + 1 < _count as _coarse", "explode(sequence(0L, _n)) as _j").selectExpr(SERIES, "_j", "_coarse", f"_lo + _j * {1 / rate!r}D as {t}")
    values = {f"_v{k}": f"avg({W.clean(c)}) OVER {W.tied(time)}" for k, c in enumerate(numeric)}
    row = "named_struct('t', cast(" + t + " as double), 'i', " + ROW + "".join(f", 'c{k}', {W.q(c)}" for k, c in enumerate(others)) + ")"
    source = sf.df.where(f"{t} is not null").selectExpr(SERIES, ROW, "cast(null as bigint) as _j", f"cast({t} as double) as {t}", f"{row} as _row", *[f"{e} as {n}" for n, e in values.items()])
    union = source.unionByName(points.withColumn(ROW, F.lit(None).cast("long")), allowMissingColumns=True)

    # For "none" a source row of the very time counts as one that follows, otherwise as one before.
    first = "_j is not null" if method == "none" else "_j is null"
    rank = f"case when {first} then 0 else 1 end"
    ahead, behind = W.past(t, rank, ROW), W.past(f"{t} DESC", f"{rank} DESC", f"{ROW} DESC")
    known = {k: f"case when _v{k} is not null then named_struct('t', {t}, 'x', _v{k}) end" for k in range(len(numeric))}
    sides = []
    for name, frame in (("a", ahead), ("b", behind)):
        sides.append([f"last(_row, true) OVER {frame} as _{name}"] + [f"last({known[k]}, true) OVER {frame} as _{name}{k}" for k in known])
    two = union.selectExpr("*", *sides[0]).selectExpr("*", *sides[1]).where("_j is not null")

    if method == "none":
        nearest = f"case when _a is null then _b when _b is null then _a when {t} - _a.t > _b.t - {t} then _b else _a end"
        picked = two.selectExpr(SERIES, "_j", t, f"{nearest} as _p").selectExpr(SERIES, "_j", t, f"case when abs({t} - _p.t) < {0.5 / rate!r}D then _p end as _p")
        out = picked.selectExpr(SERIES, f"_j as {ROW}", *[t if c == time else f"_p.c{others.index(c)} as {W.q(c)}" for c in sf.data_columns])
    else:
        stood = {c: f"coalesce(_a, _b).c{k}" for k, c in enumerate(others)}
        filled = {c: interpolate(f"_a{k}", f"_b{k}", time, method) for k, c in enumerate(numeric)}
        out = two.selectExpr(SERIES, f"_j as {ROW}", *[t if c == time else f"{(filled | stood)[c]} as {W.q(c)}" for c in sf.data_columns], "_coarse")
        if not others:
            out = out.drop("_coarse")
        else:
            step = f"cast(least(greatest(floor(bround(({t} - _lo) * {rate!r}D, 9)), 0), _n) as bigint)"
            binned = sf.df.join(g, SERIES).where(f"_n + 1 < _count and {t} is not null").withColumn("_bin", F.expr(step))
            firsts = binned.groupBy(SERIES, "_bin").agg(*[F.expr(f"min_by({W.q(c)}, {ROW}) filter (where {W.q(c)} is not null)").alias(f"_f{k}") for k, c in enumerate(others)])
            joined = out.join(firsts.withColumnRenamed("_bin", ROW), [SERIES, ROW], "left")
            out = joined.selectExpr(SERIES, ROW, *[f"case when _coarse then _f{others.index(c)} else {W.q(c)} end as {W.q(c)}" if c in others else W.q(c) for c in sf.data_columns])
    inform(f"output is resampled at {rate:g} Hz", func, verbose)
    return sf._new(out, time_channel=time, sample_rate=rate)
