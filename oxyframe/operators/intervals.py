"""Cutting intervals out of recordings, and averaging them into ensembles.

Boundaries are a DataFrame of one row an interval, joined to the samples by series
and time range. The join is by key, so Spark broadcasts the boundaries only while
they are small, and sorts both sides otherwise.
"""

from __future__ import annotations

import re
import statistics
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import args as A
from ..errors import SignalError, inform, warn
from ..frame import ROW, SERIES, SignalFrame, each_rate
from ..functions import windows as W


@dataclass(frozen=True)
class Boundary:
    """What an interval starts or ends at: times, event labels, laps or samples."""

    kind: str
    values: tuple
    ignore_case: bool = False
    fixed: bool = False


def by_time(*times: float) -> Boundary:
    """Points in time."""
    values = tuple(x for t in times for x in A.as_list(t))
    A.number("by_time", list(values), func="by_time")
    return Boundary("time", tuple(map(float, values)))


def by_label(*labels: str, ignore_case: bool = False, fixed: bool = False) -> Boundary:
    """Every row whose event matches one of the patterns (or, fixed, holds one of the strings)."""
    values = tuple(x for t in labels for x in A.as_list(t))
    if not values or not all(isinstance(v, str) for v in values):
        raise SignalError("labels must be strings", "by_label")
    if not isinstance(ignore_case, bool) or not isinstance(fixed, bool):
        raise SignalError("'ignore_case' and 'fixed' must be true or false", "by_label")
    return Boundary("label", values, ignore_case, fixed)


def by_lap(*laps: int) -> Boundary:
    """Lap numbers: an interval starts at a lap's first sample and ends at its last."""
    values = tuple(x for t in laps for x in A.as_list(t))
    A.number("by_lap", list(values), low=1, whole=True, func="by_lap")
    return Boundary("lap", tuple(map(int, values)))


def by_sample(*samples: int) -> Boundary:
    """Sample numbers, from 1."""
    values = tuple(x for t in samples for x in A.as_list(t))
    A.number("by_sample", list(values), low=1, whole=True, func="by_sample")
    return Boundary("sample", tuple(map(int, values)))


def as_boundary(x: Any, name: str = "start") -> Boundary | None:
    """int is a lap, float a time, str a label; lists of one kind likewise."""
    if x is None or isinstance(x, Boundary):
        return x
    items = A.as_list(x)
    if items and all(isinstance(v, int) and not isinstance(v, bool) for v in items):
        return by_lap(*items)
    if items and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in items):
        return by_time(*items)
    if items and all(isinstance(v, str) for v in items):
        return by_label(*items)
    raise SignalError(f"{name!r} must be numbers, labels, or by_time(), by_label(), by_lap() or by_sample()", "extract_intervals")


def span_pair(span: Any) -> tuple[float, float]:
    """(before, after); a single number is after if it is not negative, else before."""
    items = A.as_list(span)
    A.number("span", items, func="extract_intervals")
    if len(items) == 2:
        return float(items[0]), float(items[1])
    if len(items) != 1:
        raise SignalError("'span' must be one or two numbers", "extract_intervals")
    x = float(items[0])
    return (0.0, x) if x >= 0 else (x, 0.0)


def _points(sf: SignalFrame, what: Boundary, time: str, event: str | None, last: bool, func: str) -> DataFrame:
    """series, k (from 1), at: the boundary's points of each series."""
    t = f"round({W.q(time)}, 6)"
    if what.kind == "time":
        listed = ", ".join(f"{v!r}D" for v in what.values)
        return sf.df.select(SERIES).distinct().selectExpr(SERIES, f"posexplode(array({listed})) as (k0, at)").selectExpr(SERIES, "k0 + 1 as k", "at")
    if what.kind == "sample":
        listed = ", ".join(f"named_struct('k', {k + 1}, 'i', {v - 1}L)" for k, v in enumerate(what.values))
        wanted = sf.df.where(f"{ROW} in ({', '.join(str(v - 1) for v in what.values)})")
        return wanted.selectExpr(SERIES, f"{t} as at", ROW, f"inline(array({listed}))").where(f"i = {ROW}").select(SERIES, "k", "at")
    e = W.q(event)
    if what.kind == "label":
        if what.fixed:
            found = F.lit(False)
            for v in what.values:
                found = found | (F.lower(F.col(e)).contains(v.lower()) if what.ignore_case else F.col(e).contains(v))
        else:
            found = F.col(e).rlike(("(?i)" if what.ignore_case else "") + "|".join(f"(?:{v})" for v in what.values))
        rows = sf.df.where(found)
        if sf.checks and rows.isEmpty():
            raise SignalError(f"no events detected matching {', '.join(what.values)}", func)
        return rows.selectExpr(SERIES, f"row_number() OVER (PARTITION BY {SERIES} ORDER BY {ROW}) as k", f"{t} as at")
    lap = f"cast({e} as int)"
    rows = sf.df.where(f"{lap} in ({', '.join(map(str, what.values))})")
    if sf.checks:
        seen = {r[0] for r in rows.selectExpr(f"{lap} as lap").distinct().collect()}
        if missing := [str(v) for v in what.values if v not in seen]:
            raise SignalError(f"no samples found for lap {', '.join(missing)}", func)
    ends = rows.groupBy(SERIES, F.expr(lap).alias("lap")).agg(F.expr(f"{'max' if last else 'min'}_by({t}, {ROW})").alias("at"))
    listed = ", ".join(f"named_struct('k', {k + 1}, 'of', {v})" for k, v in enumerate(what.values))
    return ends.selectExpr(SERIES, "lap", "at", f"inline(array({listed}))").where("of = lap").select(SERIES, "k", "at")


def _chosen(values: list[str], key: str) -> str:
    """SQL of the k-th of the listed expressions, the last one onwards."""
    return f"element_at(array({', '.join(values)}), cast(least({key}, {len(values)}) as int))"


def boundaries(sf: SignalFrame, start: Boundary | None, end: Boundary | None, spans: list[tuple[float, float]], group_of: dict[int, int] | None, time: str, event: str | None, verbose: bool, func: str) -> DataFrame:
    """series, k, lo, hi, t0, t1 (null with one boundary), before, after."""
    if start is not None and end is not None:
        a = _points(sf, start, time, event, False, func)
        b = _points(sf, end, time, event, True, func).select(F.col(SERIES).alias("_s"), F.col("k").alias("_k"), F.col("at").alias("t1"))
        if sf.checks and verbose:
            na, nb = a.count(), b.count()
            if na != nb:
                warn(f"unequal lengths of start ({na}) and end ({nb}); intervals are paired as far as both go", func)
        at = a.join(b, (F.col(SERIES) == F.col("_s")) & (F.col("k") == F.col("_k"))).selectExpr(SERIES, "k", "at as t0", "t1")
    else:
        at = _points(sf, start or end, time, event, start is None, func).selectExpr(SERIES, "k", "at as t0", "cast(null as double) as t1")
    if group_of is not None:
        known = ", ".join(f"{k}, {g}" for k, g in group_of.items())
        key = f"coalesce(element_at(map({known}), cast(k as int)), {max(group_of.values())})"
    else:
        key = "k"
    before, after = _chosen([f"{s[0]!r}D" for s in spans], key), _chosen([f"{s[1]!r}D" for s in spans], key)
    limits = sf.df.groupBy(F.col(SERIES).alias("_s")).agg(F.expr(f"min_by(round({W.q(time)}, 6), {ROW})").alias("_first"), F.expr(f"max_by(round({W.q(time)}, 6), {ROW})").alias("_last"))
    both = at.join(limits, F.col(SERIES) == F.col("_s")).selectExpr(SERIES, "k", "t0", "t1", f"{before} as before", f"{after} as after", f"t0 + {before} as _lo", f"coalesce(t1, t0) + {after} as _hi", "_first", "_last")
    if sf.checks:
        outside, partly = both.agg(F.expr("count_if(_hi < _first or _lo > _last)"), F.expr("count_if(_lo < _first or _hi > _last)")).first()
        if outside:
            raise SignalError(f"{outside} interval(s) entirely outside data bounds", func)
        if partly:
            warn(f"{partly} interval(s) partially outside data bounds; available data are returned", func, verbose)
    inside = both.where("not (_hi < _first or _lo > _last)")
    return inside.selectExpr(SERIES, "k", "greatest(_lo, _first) as lo", "least(_hi, _last) as hi", "t0", "t1", "before", "after")


def interval_groups(groups: Any, n: int | None, verbose: bool = True, func: str = "extract_intervals") -> list[tuple[str, list[int]]] | str:
    """Named groups of interval numbers, or "distinct" or "ensemble".

    Intervals left out (of ``n``) become groups of their own, in the order of the
    groups' median numbers.
    """
    if isinstance(groups, str):
        return A.choice("group_intervals", groups, ("distinct", "ensemble"), func)
    pairs = list(groups.items()) if isinstance(groups, Mapping) else [(None, g) for g in groups]
    if not pairs:
        raise SignalError("'group_intervals' needs a group at least", func)
    listed = []
    for i, (name, g) in enumerate(pairs):
        ids = A.as_list(g)
        label = name or f"position {i + 1}"
        if not ids:
            raise SignalError(f"'group_intervals': empty group {label}", func)
        if any(isinstance(x, bool) or not isinstance(x, (int, float)) or x != int(x) for x in ids):
            raise SignalError(f"'group_intervals': group {label} must hold whole numbers", func)
        if any(x < 1 or n is not None and x > n for x in ids):
            raise SignalError(f"'group_intervals': group {label} holds numbers outside 1..{n}", func)
        listed.append((name, [int(x) for x in ids]))
    ids = [x for _, g in listed for x in g]
    if twice := sorted({x for x in ids if ids.count(x) > 1}):
        warn(f"interval(s) {', '.join(map(str, twice))} are in several groups", func, verbose)
    if n is not None and (left := [k for k in range(1, n + 1) if k not in ids]):
        inform("intervals not in 'group_intervals' are returned one by one", func, verbose)
        listed = sorted(listed + [(None, [k]) for k in left], key=lambda p: statistics.median(p[1]))
    return [(name or "interval_" + "_".join(map(str, g)), g) for name, g in listed]


@each_rate
def extract_intervals(
    sf: SignalFrame,
    channels: Any = None,
    time_channel: Any = None,
    event_channel: Any = None,
    sample_rate: float | None = None,
    group_intervals: Any = "distinct",
    group_channels: Any = None,
    start: Any = None,
    end: Any = None,
    span: Any = ((-60, 60),),
    zero_time: bool = False,
    verbose: bool = True,
) -> SignalFrame:
    """Samples of each interval as series of their own.

    With one boundary an interval is the span around it; with both it goes from start
    to end, widened by the span. Times are compared to six decimals, ends included.
    Ensembles are means at each step of the sample rate, from 0 at the first boundary;
    they hold time and channels only (and the other columns as null beside distinct
    intervals). Series are named ``interval_<k>``, or ``interval_<series>.<k>`` (and
    ``<group>_<series>``) where there are several.
    """
    func = "extract_intervals"
    sf._need_columns(2, func)
    names = sf.channel_names(channels, func)
    members = A.interval_channels(names, group_channels, func)
    time = sf.time_name(time_channel, func)
    rate = sf.rate(sample_rate, time, verbose, func)
    start, end = as_boundary(start, "start"), as_boundary(end, "end")
    if start is None and end is None:
        raise SignalError("no interval specification: give 'start' or 'end'", func)
    if any(b is not None and b.kind in ("label", "lap") for b in (start, end)):
        event = sf.event_name(event_channel, True, func)
    else:
        event = event_channel or sf.meta.event_channel
    listed_spans = isinstance(span, (list, tuple)) and any(isinstance(s, (list, tuple)) for s in span)
    spans = [span_pair(s) for s in (span if listed_spans else [span])]
    groups = group_intervals if isinstance(group_intervals, str) else dict(group_intervals) if isinstance(group_intervals, Mapping) else list(group_intervals)
    listed = interval_groups(groups, None, False, func)
    group_of = None if isinstance(listed, str) else {k: g + 1 for g, (_, ids) in enumerate(listed) for k in ids}
    cut = boundaries(sf, start, end, spans, group_of, time, event, verbose, func)
    if group_of is not None and sf.checks:
        n = cut.agg(F.max("k")).first()[0] or 0
        listed = interval_groups(groups, n, verbose, func)

    # Which groups an interval is in; a lone interval always stands for itself.
    count = f"count(*) OVER {W.whole()}"
    if listed == "distinct":
        label = "named_struct('g', concat('interval_', k), 'o', k, 'many', false)"
        cut = cut.selectExpr("*", f"{label} as _g")
    elif listed == "ensemble":
        label = f"case when {count} = 1 then named_struct('g', concat('interval_', k), 'o', 1, 'many', false) else named_struct('g', 'ensemble', 'o', 1, 'many', true) end"
        cut = cut.selectExpr("*", f"{label} as _g")
    else:
        entry = lambda o, name, ids: f"named_struct('g', {_text(name)}, 'o', {o}, 'many', {'true' if len(ids) > 1 else 'false'})"
        of: dict[int, list[str]] = {}
        for o, (name, ids) in enumerate(listed):
            for k in ids:
                of.setdefault(k, []).append(entry(o + 1, name, ids))
        known = ", ".join(f"{k}, array({', '.join(v)})" for k, v in of.items())
        alone = "array(named_struct('g', concat('interval_', k), 'o', cast(k as int), 'many', false))"
        cut = cut.selectExpr("*", f"{count} as _count").selectExpr("*", f"explode(case when _count = 1 then {alone} else coalesce(element_at(map({known}), cast(k as int)), {alone}) end) as _g").drop("_count")
    key = "element_at(map(" + ", ".join(f"{k}, {g}" for k, g in group_of.items()) + f"), cast(k as int))" if group_of else "k"
    if group_of:
        key = f"coalesce({key}, {len(members)})"
    rows = sf.df.join(cut.withColumnsRenamed({SERIES: "_s"}), (F.col(SERIES) == F.col("_s")) & F.expr(f"round({W.q(time)}, 6) between lo and hi")).drop("_s")

    t = W.q(time)
    several = f"case when _g.g like 'interval\\\\_%' then concat('interval_', {SERIES}, '.', substring(_g.g, 10)) else concat(_g.g, '_', {SERIES}) end"
    rows = rows.selectExpr("*", f"{'_g.g' if sf.lone else several} as _name")
    others = [c for c in sf.data_columns if c != time and c not in names]
    kept = rows.where("not _g.many")
    shown = f"{t} - t0" if zero_time else t
    distinct = kept.selectExpr(f"_name as {SERIES}", f"row_number() OVER (PARTITION BY _name ORDER BY {ROW}) - 1L as {ROW}", *[f"{shown} as {t}" if c == time else W.q(c) for c in sf.data_columns])
    if listed == "distinct":
        return sf._new(distinct, channels=[c for c in names if any(c in m for m in members)], time_channel=time, sample_rate=rate, event_channel=event, interval_times=cut, interval_span=spans)._several()
    used = list(dict.fromkeys(c for m in members for c in m))
    belongs = {c: _chosen([("true" if c in m else "false") for m in members], key) for c in used}
    bins = rows.where("_g.many").selectExpr("_name", f"bround(({t} - t0) * {rate!r}D, 0) / {rate!r}D as _bin", *[f"case when {belongs[c]} then {W.clean(c)} end as {W.q(c)}" for c in used]).where("_bin is not null")
    means = bins.groupBy("_name", "_bin").agg(*[F.avg(W.q(c)).alias(c) for c in used], F.count("*").alias("_n"))
    if sf.checks and verbose and not means.where("_n < 2").isEmpty():
        warn("some steps of the ensemble have one sample only; resample first", func)
    ensemble = means.selectExpr(f"_name as {SERIES}", f"row_number() OVER (PARTITION BY _name ORDER BY _bin) - 1L as {ROW}", f"_bin as {t}", *map(W.q, used))
    out = ensemble if listed == "ensemble" and sf.checks and kept.isEmpty() else distinct.unionByName(ensemble, allowMissingColumns=True)
    return sf._new(out.drop(*others) if out is ensemble else out, channels=used, time_channel=time, sample_rate=rate, event_channel=event, interval_times=cut, interval_span=spans)._several()


def _text(s: str) -> str:
    return "'" + re.sub(r"(['\\])", r"\\\1", s) + "'"
