"""Queries over the driver tables, one or more for each operator, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import ROW, SERIES, SignalFrame
from ..functions import palette, timefmt
from ..functions import windows as W
from ..meta import SignalMeta
from ..operators import filters, intervals, kernels
from ..operators import replace as rep
from ..sources import recording, tables
from ..session import folder
from ..streaming import trailing
from .signals import micros, out, sample, table, users, vectors

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def _d(x: float) -> str:
    """A double in SQL, exactly."""
    return f"CAST('{x!r}' AS DOUBLE)"


def _r(x: str, name: str) -> str:
    return f"round({x}, 6) + CAST(0 AS DOUBLE) AS {name}"


# The recordings of signals.py in SQL.
E = """e AS (SELECT *, CASE WHEN (i + vec_id) % 13 = 5 THEN CAST(9.5 AS DOUBLE) WHEN (i + vec_id) % 11 = 3 THEN NULL ELSE x END AS z
 FROM (SELECT vec_id, CAST(k - 1 AS INTEGER) AS i, CAST(k - 1 AS DOUBLE) / 10 AS t, CAST(embedding[k] AS DOUBLE) AS x,
  CAST(embedding[len(embedding) - k + 1] AS DOUBLE) AS y,
  CASE WHEN k - 1 = 10 + vec_id % 5 THEN 'start' WHEN k - 1 = 40 + vec_id % 7 THEN 'end' ELSE '' END AS ev,
  CAST((k - 1) // 8 + 1 AS INTEGER) AS lap
  FROM embeddings, unnest(range(1, len(embedding) + 1)) AS r(k)))"""
U = """u AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts)) - 1 AS i,
 CAST(epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS DOUBLE) / 1000000 AS t, value, event_type FROM events)"""


def _add(sql: str | None = None):
    def keep(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLES[f.__name__] = sql
        return f

    return keep


def _rows(a: int, b: int) -> str:
    return f"(PARTITION BY vec_id ORDER BY i ROWS BETWEEN {a} PRECEDING AND {b} FOLLOWING)"


def _near(h: float) -> str:
    return f"(PARTITION BY vec_id ORDER BY t RANGE BETWEEN {_d(h)} PRECEDING AND {_d(h)} FOLLOWING)"


# Moving averages


@_add(f"WITH {E} SELECT vec_id, i, {_r(f'avg(x) OVER {_rows(2, 2)}', 'ma')} FROM e")
def moving_average_width(spark: SparkSession, d: str) -> DataFrame:
    return out(filters.moving_average(vectors(spark, d), width=5, partial=True).df, "vec_id", "i", "x as ma")


@_add(f"WITH {E} SELECT vec_id, i, {_r(f'CASE WHEN count(*) OVER {_rows(1, 2)} < 4 OR count(z) OVER {_rows(1, 2)} < count(*) OVER {_rows(1, 2)} THEN NULL ELSE avg(z) OVER {_rows(1, 2)} END', 'ma')} FROM e")
def moving_average_complete(spark: SparkSession, d: str) -> DataFrame:
    return out(filters.moving_average(vectors(spark, d), "z", width=4, verbose=False).df, "vec_id", "i", "z as ma")


@_add(f"WITH {E} SELECT vec_id, i, {_r(f'avg(z) OVER {_near(0.3)}', 'ma')} FROM e")
def moving_average_span(spark: SparkSession, d: str) -> DataFrame:
    return out(filters.moving_average(vectors(spark, d), "z", span=0.6, partial=True, skip_null=True).df, "vec_id", "i", "z as ma")


@_add(f"WITH {E} SELECT vec_id, i, {_r(f'CASE WHEN count(*) OVER {_near(0.5)} < 8 THEN NULL ELSE avg(x) OVER {_near(0.5)} END', 'ma')} FROM e")
def moving_average_span_complete(spark: SparkSession, d: str) -> DataFrame:
    return out(filters.moving_average(vectors(spark, d), span=1.0).df, "vec_id", "i", "x as ma")


@_add(f"WITH {E} SELECT vec_id, i, {_r('avg(x) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)', 'back')} FROM e")
def moving_average_trailing(spark: SparkSession, d: str) -> DataFrame:
    return out(filters.moving_average(vectors(spark, d), width=7, partial=True, align="right").df, "vec_id", "i", "x as back")


@_add("SELECT event_id, round(avg(value) OVER (ORDER BY epoch_us(ts), event_id ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING), 6) + CAST(0 AS DOUBLE) AS ma FROM events")
def moving_average_one_long_series(spark: SparkSession, d: str) -> DataFrame:
    """A single recording, numbered by ranges and cut into chunks with overlap, so that no task holds it all."""
    e = table(spark, d, "events").selectExpr("event_id", f"{micros('ts')} as us", "value")
    sf = SignalFrame.from_df(e, channels="value", order=["us", "event_id"], checks=False, parallel=True)
    return out(filters.moving_average(sf, width=101, partial=True, chunk_rows=2000).df, "event_id", "value as ma")


# Cleaning


@_add(f"WITH {E} SELECT vec_id, i, {_r('CASE WHEN z = 9.5 OR z <= -0.3 OR z >= 0.4 THEN NULL ELSE z END', 'z')} FROM e")
def replace_invalid_null(spark: SparkSession, d: str) -> DataFrame:
    return out(rep.replace_invalid(vectors(spark, d), "z", invalid_values=[9.5], invalid_below=-0.3, invalid_above=0.4, method="none").df, "vec_id", "i", "z")


@_add(f"""WITH {E}, b AS (SELECT *, coalesce(z >= 0.25, false) AS bad FROM e), c AS (SELECT *, CASE WHEN bad THEN NULL ELSE z END AS w FROM b)
SELECT vec_id, i, {_r(f'CASE WHEN bad THEN median(w) OVER {_rows(2, 2)} ELSE w END', 'z')} FROM c""")
def replace_invalid_median(spark: SparkSession, d: str) -> DataFrame:
    return out(rep.replace_invalid(vectors(spark, d), "z", invalid_above=0.25, width=5).df, "vec_id", "i", "z")


_HAMPEL = """s AS (SELECT *, abs({x} - last_value({x} IGNORE NULLS) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS step,
 list({x}) FILTER (WHERE {x} IS NOT NULL) OVER {w} AS l FROM {src}),
 m AS (SELECT *, list_median(l) AS med, coalesce(min(step) FILTER (WHERE step > 1e-5) OVER (PARTITION BY vec_id), CAST('Infinity' AS DOUBLE)) AS least FROM s),
 h AS (SELECT *, coalesce(abs({x} - med) > least AND abs({x} - med) > 1.4826 * 3 * list_median(list_transform(l, lambda v: abs(v - med))), false) AS odd FROM m)"""


@_add(f"WITH {E}, {_HAMPEL.format(x='z', w=_rows(3, 3), src='e')} SELECT vec_id, i, {_r('CASE WHEN odd THEN med ELSE z END', 'z')} FROM h")
def replace_outliers_width(spark: SparkSession, d: str) -> DataFrame:
    return out(rep.replace_outliers(vectors(spark, d), "z", outlier_cutoff=3, width=7).df, "vec_id", "i", "z")


@_add(f"WITH {E}, {_HAMPEL.format(x='z', w=_near(0.4), src='e')} SELECT vec_id, i, {_r('CASE WHEN odd THEN NULL ELSE z END', 'z')} FROM h")
def replace_outliers_span(spark: SparkSession, d: str) -> DataFrame:
    return out(rep.replace_outliers(vectors(spark, d), "z", outlier_cutoff=3, span=0.8, method="none").df, "vec_id", "i", "z")


def _ends(x: str, src: str, key: str = "vec_id", t: str = "t", i: str = "i") -> str:
    past, ahead = f"(PARTITION BY {key} ORDER BY {t}, {i} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", f"(PARTITION BY {key} ORDER BY {t}, {i} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    kt = f"CASE WHEN {x} IS NOT NULL THEN {t} END"
    return f"SELECT *, last_value({kt} IGNORE NULLS) OVER {past} AS t0, last_value({x} IGNORE NULLS) OVER {past} AS x0, first_value({kt} IGNORE NULLS) OVER {ahead} AS t1, first_value({x} IGNORE NULLS) OVER {ahead} AS x1 FROM {src}"


_LINE = "CASE WHEN x0 IS NULL THEN x1 WHEN x1 IS NULL OR t0 = t OR t1 = t0 THEN x0 ELSE x0 + (x1 - x0) * (t - t0) / (t1 - t0) END"


@_add(f"WITH {E}, k AS ({_ends('z', 'e')}) SELECT vec_id, i, {_r(_LINE, 'z')} FROM k")
def replace_missing_linear(spark: SparkSession, d: str) -> DataFrame:
    return out(rep.replace_missing(vectors(spark, d), "z").df, "vec_id", "i", "z")


@_add(f"WITH {E}, k AS ({_ends('z', 'e')}) SELECT vec_id, i, {_r('coalesce(x0, x1)', 'z')} FROM k")
def replace_missing_locf(spark: SparkSession, d: str) -> DataFrame:
    return out(rep.replace_missing(vectors(spark, d), "z", method="locf").df, "vec_id", "i", "z")


@_add(f"""WITH {E}, n AS (SELECT *, count(z) OVER (PARTITION BY vec_id ORDER BY i) AS p FROM e), v AS (SELECT vec_id, p, z FROM n WHERE z IS NOT NULL),
 m AS (SELECT n.vec_id, n.i, median(v.z) AS m FROM n JOIN v ON n.vec_id = v.vec_id AND v.p BETWEEN n.p - 1 AND n.p + 2 WHERE n.z IS NULL GROUP BY ALL)
SELECT e.vec_id, e.i, {_r('coalesce(e.z, m.m)', 'z')} FROM e LEFT JOIN m ON e.vec_id = m.vec_id AND e.i = m.i""")
def replace_missing_median_width(spark: SparkSession, d: str) -> DataFrame:
    return out(rep.replace_missing(vectors(spark, d), "z", width=4, method="median").df, "vec_id", "i", "z")


@_add(f"WITH {E} SELECT vec_id, i, {_r(f'coalesce(z, median(z) OVER {_near(0.3)})', 'z')} FROM e")
def replace_missing_median_span(spark: SparkSession, d: str) -> DataFrame:
    return out(rep.replace_missing(vectors(spark, d), "z", span=0.6, method="median").df, "vec_id", "i", "z")


_ORDERS = """o AS (SELECT o_orderkey, o_orderpriority, o_orderkey AS i, CAST(epoch_us(o_orderdate) // 86400000000 AS DOUBLE) AS t, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS p FROM orders)"""


@_add(f"WITH {_ORDERS}, v AS (SELECT *, avg(p) OVER (PARTITION BY o_orderpriority, t) AS w FROM o), k AS ({_ends('w', 'v', 'o_orderpriority')}) SELECT o_orderkey, round({_LINE}, 8) + CAST(0 AS DOUBLE) AS p FROM k")
def replace_missing_tied_times(spark: SparkSession, d: str) -> DataFrame:
    """Many orders a day, in five series: rows of equal time get their mean."""
    o = table(spark, d, "orders").selectExpr("o_orderkey", "o_orderpriority", "cast(unix_date(cast(o_orderdate as date)) as double) as t", "case when o_orderkey % 3 = 0 then null else o_totalprice end as p")
    sf = SignalFrame.from_df(o, "t", "p", series="o_orderpriority", order=["t", "o_orderkey"], checks=False)
    return out(rep.replace_missing(sf, by_time=True).df, "o_orderkey", "p", digits=8)


@_add(f"""WITH {E}, q AS (SELECT vec_id, i, t, CASE WHEN z <= -0.3 THEN NULL ELSE z END AS z FROM e), {_HAMPEL.format(x='z', w=_rows(3, 3), src='q')},
 f AS (SELECT vec_id, i, t, CASE WHEN odd THEN NULL ELSE z END AS z FROM h), k AS ({_ends('z', 'f')}) SELECT vec_id, i, {_r(_LINE, 'z')} FROM k""")
def replace_all(spark: SparkSession, d: str) -> DataFrame:
    """Limits, then outliers, then gaps."""
    return out(vectors(spark, d).replace(channels="z", invalid_below=-0.3, outlier_cutoff=3, width=7).df, "vec_id", "i", "z")


# Resampling

_DAY4 = 1 / 21600


def _grid(src: str, key: str, rate: float) -> str:
    r = _d(rate)
    return f"""b AS (SELECT {key}, floor(min(t) * {r}) / {r} AS lo, round_even(max(t) * {r}, 0) / {r} AS hi, count(*) AS n_in FROM {src} GROUP BY {key}),
 n AS (SELECT {key}, lo, n_in, CAST(floor((hi - lo) * {r} + 1e-10) AS BIGINT) AS n FROM b),
 g AS (SELECT {key}, j, lo, n, n_in, lo + j * {_d(1 / rate)} AS t FROM n, unnest(range(0, n + 1)) AS r(j))"""


@_add(f"""WITH {U}, {_grid('u', 'user_id', _DAY4)},
 l AS (SELECT g.user_id, g.j, g.t, s.t AS lt, s.value AS lv, s.event_type AS le FROM g ASOF LEFT JOIN u s ON g.user_id = s.user_id AND g.t > s.t),
 m AS (SELECT l.*, s.t AS rt, s.value AS rv, s.event_type AS re FROM l ASOF LEFT JOIN u s ON l.user_id = s.user_id AND l.t <= s.t),
 p AS (SELECT *, lt IS NULL OR (rt IS NOT NULL AND t - lt > rt - t) AS fwd FROM m)
SELECT CAST(user_id AS VARCHAR) AS series, j, {_r('t', 't')},
 CASE WHEN abs(t - CASE WHEN fwd THEN rt ELSE lt END) < {_d(0.5 / _DAY4)} THEN CASE WHEN fwd THEN rv ELSE lv END END AS value,
 CASE WHEN abs(t - CASE WHEN fwd THEN rt ELSE lt END) < {_d(0.5 / _DAY4)} THEN CASE WHEN fwd THEN re ELSE le END END AS event_type FROM p""")
def resample_nearest(spark: SparkSession, d: str) -> DataFrame:
    return out(users(spark, d).resample(resample_rate=_DAY4, verbose=False).df, "series", f"{ROW} as j", "t", "value", "event_type")


def _resampled(rate: float, value: str) -> str:
    return f"""WITH {U}, {_grid('u', 'user_id', rate)}, k AS (SELECT user_id, NULL AS j, i, 0 AS f, t, value, event_type FROM u UNION ALL SELECT user_id, j, NULL, 1, t, NULL, NULL FROM g),
 w AS ({_ends('value', 'k', 'user_id', 't', 'f')}),
 a AS (SELECT g.user_id, g.j, s.event_type AS stood FROM g ASOF LEFT JOIN u s ON g.user_id = s.user_id AND g.t >= s.t),
 c AS (SELECT user_id, k, arg_min(event_type, i) AS firsts FROM (SELECT u.user_id, u.i, u.event_type, CAST(least(greatest(floor(round_even((u.t - n.lo) * {_d(rate)}, 9)), 0), n.n) AS BIGINT) AS k FROM u JOIN n USING (user_id)) GROUP BY ALL)
SELECT CAST(g.user_id AS VARCHAR) AS series, g.j, {_r('g.t', 't')}, {_r(value, 'value')}, CASE WHEN g.n + 1 < g.n_in THEN c.firsts ELSE a.stood END AS event_type
FROM g JOIN (SELECT * FROM w WHERE f = 1) w ON g.user_id = w.user_id AND g.j = w.j JOIN a ON g.user_id = a.user_id AND g.j = a.j LEFT JOIN c ON g.user_id = c.user_id AND g.j = c.k"""


@_add(_resampled(_DAY4, _LINE.replace("= t ", "= w.t ").replace("(t -", "(w.t -")))
def resample_linear(spark: SparkSession, d: str) -> DataFrame:
    return out(users(spark, d).resample(resample_rate=_DAY4, method="linear", verbose=False).df, "series", f"{ROW} as j", "t", "value", "event_type")


@_add(_resampled(_DAY4 / 4, "coalesce(x0, x1)"))
def resample_locf_coarse(spark: SparkSession, d: str) -> DataFrame:
    return out(users(spark, d).resample(resample_rate=_DAY4 / 4, method="locf", verbose=False).df, "series", f"{ROW} as j", "t", "value", "event_type")


@_add(f"""WITH {E}, {_grid('e', 'vec_id', 25.0)}, k AS (SELECT vec_id, NULL AS j, 0 AS f, t, z FROM e UNION ALL SELECT vec_id, j, 1, t, NULL FROM g), w AS ({_ends('z', 'k', 'vec_id', 't', 'f')})
SELECT CAST(vec_id AS VARCHAR) AS series, j, {_r('t', 't')}, {_r(_LINE, 'z')} FROM w WHERE f = 1""")
def resample_finer(spark: SparkSession, d: str) -> DataFrame:
    sf = vectors(spark, d)
    return out(SignalFrame(sf.df.select(SERIES, ROW, "t", "z"), sf.meta, False).resample(resample_rate=25, method="linear", verbose=False).df, "series", f"{ROW} as j", "t", "z")


# Filters

_N, _PAD = 64, 3


def _both_ways(order: int, cutoff, kind: str, mirrored: bool) -> str:
    """The recursion as a convolution with its impulse response, forward and backward, over padded ends."""
    b, a = kernels.butterworth(order, cutoff, kind)
    total = _N + 2 * _PAD + 2 * max(len(a), len(b))
    h = ", ".join(f"{float(v):.17e}" for v in kernels.recurse(b, a, np.eye(total)[0]))
    first, last = (f"{_PAD} - 1 - n", f"{_N} - 1 - (n - {_PAD + _N})") if mirrored else ("0", f"{_N - 1}")
    return f"""WITH {E}, h AS (SELECT k, [{h}][k + 1] AS c FROM range({total}) AS r(k)),
 p AS (SELECT vec_id, q.n AS n, x FROM e JOIN (SELECT n, CASE WHEN n < {_PAD} THEN {first} WHEN n < {_PAD + _N} THEN n - {_PAD} ELSE {last} END AS i FROM range({_N + 2 * _PAD}) AS r(n)) q ON e.i = q.i),
 f AS (SELECT p.vec_id, p.n + h.k AS n, sum(h.c * p.x) AS y FROM p, h WHERE p.n + h.k < {total} GROUP BY ALL),
 b AS (SELECT f.vec_id, f.n - h.k AS n, sum(h.c * f.y) AS y FROM f, h WHERE f.n - h.k >= 0 GROUP BY ALL)
SELECT vec_id, CAST(n - {_PAD} AS INTEGER) AS i, {_r('y', 'x')} FROM b WHERE n >= {_PAD} AND n < {_PAD + _N}"""


@_add(_both_ways(2, 0.3, "low", True))
def filter_butterworth(spark: SparkSession, d: str) -> DataFrame:
    return out(vectors(spark, d).filter(method="butterworth", order=2, W_=0.3, verbose=False).df, "vec_id", "i", "x")


@_add(_both_ways(2, (0.1, 0.4), "pass", False))
def filter_butterworth_pass(spark: SparkSession, d: str) -> DataFrame:
    return out(vectors(spark, d).filter(method="butterworth", type="pass", fc=(0.5, 2.0), edges="rep1", verbose=False).df, "vec_id", "i", "x")


@_add()
def filter_smooth_spline(spark: SparkSession, d: str) -> DataFrame:
    return out(vectors(spark, d).filter(method="smooth_spline", spar=0.6, verbose=False).df, "vec_id", "i", "x")


# Shift and rescale

_MEAN11 = f"CASE WHEN count(*) OVER {_rows(5, 5)} < 11 THEN NULL ELSE avg({{c}}) OVER {_rows(5, 5)} END"


@_add(f"""WITH {E}, m AS (SELECT *, {_MEAN11.format(c='x')} AS mx, {_MEAN11.format(c='y')} AS my FROM e),
 r AS (SELECT *, least(min(mx) OVER (PARTITION BY vec_id), min(my) OVER (PARTITION BY vec_id)) AS ref FROM m)
SELECT vec_id, i, {_r('x - ref + 10', 'x')}, {_r('y - ref + 10', 'y')} FROM r""")
def shift_to_least(spark: SparkSession, d: str) -> DataFrame:
    return out(vectors(spark, d).shift(channels=["x", "y"], to=10.0, width=11).df, "vec_id", "i", "x", "y")


@_add(f"""WITH {E}, m AS (SELECT *, CASE WHEN count(*) OVER {_near(0.5)} < 8 THEN NULL ELSE avg(x) OVER {_near(0.5)} END AS mx, CASE WHEN count(*) OVER {_near(0.5)} < 8 THEN NULL ELSE avg(y) OVER {_near(0.5)} END AS my FROM e)
SELECT vec_id, i, {_r('x - max(mx) OVER (PARTITION BY vec_id) + 100', 'x')}, {_r('y - max(my) OVER (PARTITION BY vec_id) + 100', 'y')} FROM m""")
def shift_to_greatest_distinct(spark: SparkSession, d: str) -> DataFrame:
    return out(vectors(spark, d).shift(channels=["x", "y"], group_channels="distinct", to=100.0, span=1.0, position="max").df, "vec_id", "i", "x", "y")


@_add(f"""WITH {E}, m AS (SELECT *, avg(CASE WHEN t <= 0.5 THEN x END) OVER (PARTITION BY vec_id) AS mx, avg(CASE WHEN t <= 0.5 THEN y END) OVER (PARTITION BY vec_id) AS my FROM e)
SELECT vec_id, i, {_r('x - (mx + my) / 2 + 0', 'x')}, {_r('y - (mx + my) / 2 + 0', 'y')} FROM m""")
def shift_to_first(spark: SparkSession, d: str) -> DataFrame:
    return out(vectors(spark, d).shift(channels=["x", "y"], to=0.0, span=0.5, position="first").df, "vec_id", "i", "x", "y")


@_add(f"WITH {E} SELECT vec_id, i, {_r('x + 2.5', 'x')}, {_r('y + -1.5', 'y')} FROM e")
def shift_by(spark: SparkSession, d: str) -> DataFrame:
    return out(vectors(spark, d).shift(channels=["x", "y"], group_channels="distinct", by={"x": 2.5, "y": -1.5}).df, "vec_id", "i", "x", "y")


@_add(f"""WITH {E}, m AS (SELECT *, least(min(x) OVER p, min(y) OVER p) AS lo, greatest(max(x) OVER p, max(y) OVER p) AS hi FROM e WINDOW p AS (PARTITION BY vec_id))
SELECT vec_id, i, {_r('(x - lo) / (hi - lo) * 100', 'x')}, {_r('(y - lo) / (hi - lo) * 100', 'y')} FROM m""")
def rescale_ensemble(spark: SparkSession, d: str) -> DataFrame:
    return out(vectors(spark, d).rescale(channels=["x", "y"], range=(0, 100)).df, "vec_id", "i", "x", "y")


@_add(f"""WITH {U}, m AS (SELECT *, min(value) OVER p AS lo, max(value) OVER p AS hi FROM u WINDOW p AS (PARTITION BY user_id))
SELECT user_id, i, {_r('CASE WHEN hi = lo THEN value ELSE (value - lo) / (hi - lo) * 2 + -1 END', 'value')} FROM m""")
def rescale_distinct(spark: SparkSession, d: str) -> DataFrame:
    return out(users(spark, d).rescale(group_channels="distinct", range=(-1, 1)).df, "user_id", f"{ROW} as i", "value")


# Intervals

_LIMITS = "lim AS (SELECT vec_id AS v, round(min(t), 6) AS a, round(max(t), 6) AS b FROM e GROUP BY vec_id)"


def _cut(points: str, before: float, after: float, zero: bool = False) -> str:
    shown = "t - t0" if zero else "t"
    return f"""WITH {E}, {_LIMITS}, pts AS ({points}),
 iv AS (SELECT vec_id AS v, k, t0, greatest(t0 + {_d(before)}, a) AS lo, least(coalesce(t1, t0) + {_d(after)}, b) AS hi FROM pts JOIN lim ON vec_id = v)
SELECT 'interval_' || vec_id || '.' || k AS series, vec_id, i, {_r(shown, 't')}, {_r('x', 'x')} FROM e JOIN iv ON vec_id = v AND round(t, 6) BETWEEN lo AND hi"""


@_add(_cut("SELECT DISTINCT vec_id, k, [2.0, 4.0, 6.2][k]::DOUBLE AS t0, NULL::DOUBLE AS t1 FROM e, unnest([1, 2, 3]) AS r(k)", -0.5, 0.7))
def intervals_by_time(spark: SparkSession, d: str) -> DataFrame:
    return out(vectors(spark, d).extract_intervals(start=intervals.by_time(2.0, 4.0, 6.2), span=(-0.5, 0.7)).df, "series", "vec_id", "i", "t", "x")


@_add(_cut("SELECT s.vec_id, 1 AS k, round(s.t, 6) AS t0, round(f.t, 6) AS t1 FROM e s JOIN e f ON s.vec_id = f.vec_id AND s.ev = 'start' AND f.ev = 'end'", -0.2, 0.3, True))
def intervals_by_label(spark: SparkSession, d: str) -> DataFrame:
    return out(vectors(spark, d).extract_intervals(start=intervals.by_label("^STA", ignore_case=True), end=intervals.by_label("end", fixed=True), span=(-0.2, 0.3), zero_time=True, verbose=False).df, "series", "vec_id", "i", "t", "x")


@_add(_cut("SELECT vec_id, 1 AS k, round(min(t) FILTER (WHERE lap = 2), 6) AS t0, round(max(t) FILTER (WHERE lap = 4), 6) AS t1 FROM e GROUP BY vec_id", 0.0, 0.0))
def intervals_by_lap(spark: SparkSession, d: str) -> DataFrame:
    return out(vectors(spark, d).extract_intervals(event_channel="lap", start=intervals.by_lap(2), end=intervals.by_lap(4), span=(0, 0), verbose=False).df, "series", "vec_id", "i", "t", "x")


@_add(_cut("SELECT vec_id, CASE i WHEN 10 THEN 1 ELSE 2 END AS k, round(t, 6) AS t0, NULL::DOUBLE AS t1 FROM e WHERE i IN (10, 30)", 0.0, 1.5))
def intervals_by_sample(spark: SparkSession, d: str) -> DataFrame:
    return out(vectors(spark, d).extract_intervals(start=intervals.by_sample(11, 31), span=1.5).df, "series", "vec_id", "i", "t", "x")


def _mean_of(which: str, name: str) -> str:
    return f"SELECT '{name}_' || vec_id AS series, {_r('round_even((t - t0) * 10, 0) / 10', 't')}, {_r('avg(x)', 'x')}, {_r('avg(y)', 'y')} FROM cut WHERE k IN ({which}) GROUP BY vec_id, round_even((t - t0) * 10, 0) / 10"


_THREE = f"WITH {E}, cut AS (SELECT e.*, k, t0 FROM e, (SELECT k, [1.0, 3.0, 5.0][k]::DOUBLE AS t0 FROM unnest([1, 2, 3]) AS r(k)) p WHERE round(t, 6) BETWEEN t0 - 0.5 AND t0 + 1.0)"


@_add(f"{_THREE} {_mean_of('1, 2, 3', 'ensemble')}")
def intervals_ensemble(spark: SparkSession, d: str) -> DataFrame:
    return out(vectors(spark, d).extract_intervals(channels=["x", "y"], start=intervals.by_time(1.0, 3.0, 5.0), span=(-0.5, 1.0), group_intervals="ensemble").df, "series", "t", "x", "y")


@_add(f"{_THREE} {_mean_of('1, 3', 'odd')} UNION ALL SELECT 'interval_' || vec_id || '.2', {_r('t', 't')}, {_r('x', 'x')}, {_r('y', 'y')} FROM cut WHERE k = 2")
def intervals_grouped(spark: SparkSession, d: str) -> DataFrame:
    return out(vectors(spark, d).extract_intervals(channels=["x", "y"], start=intervals.by_time(1.0, 3.0, 5.0), span=(-0.5, 1.0), group_intervals={"odd": [1, 3]}).df, "series", "t", "x", "y")


# Checks, presentation, sources


@_add(f"""WITH {E}, s AS (SELECT vec_id, t - lag(t) OVER (PARTITION BY vec_id ORDER BY i) AS d FROM e), m AS (SELECT vec_id, 1 / median(d) AS r FROM s GROUP BY vec_id),
 c AS (SELECT vec_id, k, abs(l[k] - r) AS gap, l[k] AS rate FROM m, (SELECT [{', '.join(f'{r!r}' for r in W.RATES)}]::DOUBLE[] AS l), unnest(range(1, {len(W.RATES) + 1})) AS q(k))
SELECT vec_id, arg_min(rate, gap + k * 1e-9) AS rate FROM c GROUP BY vec_id""")
def sample_rates(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).estimated_rates().selectExpr(f"cast({SERIES} as bigint) as vec_id", "rate")


def _mixed(spark: SparkSession, d: str) -> SignalFrame:
    """Recordings at 10, 5 and 1 Hz, rates unknown."""
    sf = vectors(spark, d)
    slow = sf.df.withColumn("t", F.expr("t * case vec_id % 3 when 0 then 1 when 1 then 2 else 10 end"))
    return SignalFrame(slow, sf.meta.with_(sample_rate=None), True)


@_add(f"WITH {E} SELECT DISTINCT vec_id, CAST(CASE vec_id % 3 WHEN 0 THEN 10 WHEN 1 THEN 5 ELSE 1 END AS DOUBLE) AS rate FROM e")
def sample_rates_mixed(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d).estimated_rates().selectExpr(f"cast({SERIES} as bigint) as vec_id", "rate")


@_add(f"""WITH {E}, m AS (SELECT vec_id, i, t * CASE vec_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 10 END AS t, x, CASE vec_id % 3 WHEN 0 THEN 10 WHEN 1 THEN 5 ELSE 1 END AS r FROM e),
 b AS (SELECT vec_id, r, n, round_even((t - 10.0 * n / r) * r, 0) / r AS t, x FROM m, (VALUES (1), (4)) AS v(n) WHERE round(t, 6) BETWEEN round(10.0 * n / r - 2.0, 6) AND round(10.0 * n / r + 3.0, 6))
SELECT 'ensemble_' || vec_id AS series, {_r('t', 't')}, {_r('avg(x)', 'x')} FROM b GROUP BY vec_id, t""")
def intervals_mixed_rates(spark: SparkSession, d: str) -> DataFrame:
    """Ensembles around the 11th and 41st sample, each recording's steps by its own rate, with all checks on."""
    return out(_mixed(spark, d).extract_intervals(start=intervals.by_sample(11, 41), span=(-2, 3), group_intervals="ensemble", verbose=False).df, "series", "t", "x")


@_add(f"""WITH {E}, s AS (SELECT vec_id, i, CASE WHEN i = 20 THEN CAST(1.9 AS DOUBLE) WHEN i = 30 THEN CAST(2.95 AS DOUBLE) - 1 WHEN i = 63 THEN t + 4000 ELSE t END AS t FROM e),
 f AS (SELECT vec_id, i, t, count(*) OVER (PARTITION BY vec_id, t) > 1 AS repeated, coalesce(t - lag(t) OVER w < 0, false) AS falls, coalesce(t - lag(t) OVER w >= 3600, false) AS gap FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY i))
SELECT CAST(vec_id AS VARCHAR) AS series, CAST(i AS BIGINT) AS i, {_r('t', 't')}, repeated, falls, gap FROM f WHERE repeated OR falls OR gap""")
def irregular_samples(spark: SparkSession, d: str) -> DataFrame:
    sf = vectors(spark, d)
    odd = sf.df.withColumn("t", F.expr("case when i = 20 then 1.9D when i = 30 then 2.95D - 1 when i = 63 then t + 4000 else t end"))
    return out(SignalFrame(odd, sf.meta, False).irregular_samples(), SERIES, f"{ROW} as i", "time as t", "repeated", "falls", "gap")


@_add(f"WITH {E} SELECT CAST(vec_id AS VARCHAR) AS series, CAST(i AS BIGINT) AS i, {_r('t', 't')}, c AS channel, {_r('v', 'value')} FROM (SELECT vec_id, i, t, unnest(['x', 'z']) AS c, unnest([x, z]) AS v FROM e) WHERE v IS NOT NULL")
def plot_rows(spark: SparkSession, d: str) -> DataFrame:
    return out(palette.plot_data(vectors(spark, d), ["x", "z"], drop_null=True), "series", f"{ROW} as i", "time as t", "channel", "value")


@_add(f"""WITH {U}, m AS (SELECT user_id, floor(max(t)) AS s FROM u GROUP BY user_id)
SELECT user_id, (CAST(s AS BIGINT) // 3600)::VARCHAR || ':' || lpad((CAST(s AS BIGINT) % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((CAST(s AS BIGINT) % 60)::VARCHAR, 2, '0') AS took FROM m""")
def durations(spark: SparkSession, d: str) -> DataFrame:
    m = users(spark, d).df.groupBy("user_id").agg(F.floor(F.max("t")).cast("double").alias("s"))
    return timefmt.with_hmmss(m, "s", "took").select("user_id", "took")


@_add("""SELECT CAST(2 * i AS DOUBLE) AS "time", CAST(70 - i % 40 AS DOUBLE) AS smo2, CAST(i // 30 + 1 AS INTEGER) AS lap FROM range(120) AS r(i)""")
def read_example(spark: SparkSession, d: str) -> DataFrame:
    """The built-in example file, parsed."""
    p = recording.parse(tables.cells(recording.example("ramp"), "ramp.csv"), {"smo2": "SmO2 Live"}, {"time": "hh:mm:ss"}, {"lap": "Lap"}, verbose=False)
    return spark.createDataFrame(list(zip(*(p.columns[c] for c in ("time", "smo2", "lap")), strict=True)), "time double, smo2 double, lap int")


def _files(spark: SparkSession, d: str, head: str, row: str) -> DataFrame:
    """Each embedding as a device's export: lines of text before the header, then a line a sample.

    ``row`` is SQL of ``vec_id`` and a sample ``s`` (of ``sample``). What is dealt out is an embedding, not its lines.
    """
    # By number, as parsing takes long for few bytes: partitions would be put together by their bytes.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    e = table(spark, d, "embeddings").select("vec_id", "embedding").where("size(embedding) > 0").repartition(tasks, "vec_id")
    lines = f"transform(transform(embedding, (f, i) -> {sample('embedding', 'f', 'i')}), s -> {row})"
    return e.selectExpr("concat('/export/', vec_id, '.csv') as path", f"cast(concat('{head}', array_join({lines}, '\\n')) as binary) as content")


def _parsed(files: DataFrame, *args: Any, **kw: Any) -> DataFrame:
    sf = recording.parse_recordings(files, *args, describe=True, **kw)
    return out(sf.df, f"{SERIES} as series", f"{ROW} as i", "time", *sf.meta.channels, "lap", "device", "rate")


_FILE = "CAST(vec_id AS VARCHAR) AS series, CAST(i AS BIGINT) AS i"


@_add(f"WITH {E} SELECT vec_id, i, {_r(f'max(z) OVER {_rows(3, 3)} - min(z) OVER {_rows(3, 3)}', 'z')}, {_r(f'stddev_samp(x) OVER {_near(0.25)}', 'x')} FROM e")
def local_functions(spark: SparkSession, d: str) -> DataFrame:
    """A Python function of each window by samples, a SQL aggregate of each by time."""
    sf = filters.local_fun(vectors(spark, d), "z", lambda w: max(w) - min(w), width=7)
    return out(filters.local_fun(sf, "x", "stddev_samp", span=0.5).df, "vec_id", "i", "z", "x")


@_add(f"""WITH {E} SELECT {_FILE}, CAST(2 * i AS DOUBLE) AS "time", CAST(round(x * 100) AS DOUBLE) / 100 + CAST(0 AS DOUBLE) AS smo2, CAST(lap AS VARCHAR) AS lap, 'Moxy' AS device, CAST(0.5 AS DOUBLE) AS rate FROM e""")
def read_times_of_day(spark: SparkSession, d: str) -> DataFrame:
    """Times of day, which count from the first one; text before the header; a rate below one."""
    head = "\\n FW 12\\n \\nmm-dd,hh:mm:ss,SmO2 Live,SmO2 Averaged,THb,Lap,Session Ct\\n"
    at = "47833 + 2 * s.i"
    row = f"concat('06-Feb,', format_string('%02d:%02d:%02d', ({at}) div 3600, ({at}) % 3600 div 60, ({at}) % 60), ',', cast(round(s.x * 100) as bigint) / 100, ',1,12.1,', s.lap, ',1')"
    return _parsed(_files(spark, d, head, row), {"smo2": "SmO2 Live"}, event_channel={"lap": "Lap"})


@_add(f"""WITH {E} SELECT {_FILE}, CAST(i AS DOUBLE) / 10 AS "time", CAST(round(x * 100) AS DOUBLE) / 100 + CAST(0 AS DOUBLE) AS l, CAST(round(y * 100) AS DOUBLE) / 100 + CAST(0 AS DOUBLE) AS r, CASE WHEN i % 8 = 0 THEN CAST(lap AS VARCHAR) END AS lap, 'Train.Red' AS device, CAST(10 AS DOUBLE) AS rate FROM e""")
def read_repeated_headings(spark: SparkSession, d: str) -> DataFrame:
    """Two columns of one heading, empty events, times from zero."""
    head = "Device,Train\\nTimestamp (seconds passed),Lap/Event,SmO2,SmO2\\n"
    row = "concat(cast(100.1BD + s.i * 0.1BD as decimal(9, 1)), ',', if(s.i % 8 = 0, cast(s.lap as string), ''), ',', cast(round(s.x * 100) as bigint) / 100, ',', cast(round(s.y * 100) as bigint) / 100)"
    return _parsed(_files(spark, d, head, row), {"l": "SmO2", "r": "SmO2"}, event_channel={"lap": "Lap/Event"}, zero_time=True)


@_add(f"""WITH {E} SELECT {_FILE}, CAST(i + 1 AS DOUBLE) AS "time", CASE WHEN z IS NULL THEN NULL ELSE CAST(round(z * 100) AS DOUBLE) / 100 + CAST(0 AS DOUBLE) END AS smo2, '70' AS lap, 'VO2master' AS device, CAST(1 AS DOUBLE) AS rate FROM e""")
def read_decimal_commas(spark: SparkSession, d: str) -> DataFrame:
    """Quoted decimal commas and empty cells."""
    row = "concat(s.i + 1, ',00:00:01,70,\"', coalesce(replace(cast(cast(round(s.z * 100) as bigint) / 100 as string), '.', ','), ''), '\"')"
    return _parsed(_files(spark, d, "Time[s],Time[hh:mm:ss],HR[bpm],SmO2[%]\\n", row), {"smo2": "SmO2[%]"}, event_channel={"lap": "HR[bpm]"})


@_add("""SELECT event_type AS series, time_bucket(INTERVAL 1 DAY, ts) AS "begin", round(avg(CASE WHEN value >= 40 THEN NULL ELSE value END), 6) + CAST(0 AS DOUBLE) AS mean, count(*) AS n FROM events GROUP BY ALL""")
def stream_daily_mean(spark: SparkSession, d: str) -> DataFrame:
    """A stream over the events, run to its end."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{d}/event*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    means = trailing.windowed_mean(trailing.invalid_to_null(stream, ["value"], above=40), "event_type", "ts", "value", "1 day")
    path = folder(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows")

    means.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return out(spark.read.parquet(f"{path}/rows"), "series", "cast(begin as timestamp_ntz) as begin", "mean", "n")


@_add(f"""WITH {E}, q AS (SELECT vec_id, i, t, CASE WHEN z >= 5 THEN NULL ELSE z END AS z FROM e), k AS ({_ends('z', 'q')}), f AS (SELECT vec_id, i, t, {_LINE} AS z FROM k),
 s AS (SELECT vec_id, i, t, avg(z) OVER {_rows(2, 2)} AS z FROM f), m AS (SELECT *, min(z) OVER p AS lo, max(z) OVER p AS hi FROM s WINDOW p AS (PARTITION BY vec_id))
SELECT vec_id, i, {_r('(z - lo) / (hi - lo) * 100', 'z')} FROM m""")
def clean_smooth_rescale(spark: SparkSession, d: str) -> DataFrame:
    """Invalid values out, gaps filled, smoothed, on a scale of 0 to 100."""
    sf = vectors(spark, d).with_meta(channels="z").replace(invalid_above=5)
    return out(filters.moving_average(sf, width=5, partial=True).rescale(range=(0, 100)).df, "vec_id", "i", "z")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return clean_smooth_rescale(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
