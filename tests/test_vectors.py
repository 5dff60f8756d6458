"""Known inputs and outputs of single operators."""

import random
import warnings

import numpy as np
import pytest

from oxyframe.errors import SignalError, SignalWarning
from oxyframe.frame import SignalFrame
from oxyframe.meta import SignalMeta
from oxyframe.operators import filters, kernels
from oxyframe.operators import replace as rep

from .helpers import near, vector

N = None


@pytest.mark.parametrize(
    ("x", "kw", "want"),
    [
        ([1.0, 2.0, 3.0, 4.0, 5.0], {"width": 3}, [N, 2, 3, 4, N]),
        ([1.0, 2.0, 3.0, 4.0, 5.0], {"width": 3, "partial": True}, [1.5, 2, 3, 4, 4.5]),
        ([1.0, N, 3.0, 4.0, 5.0], {"width": 3}, [N, N, N, 4, N]),
        ([1.0, N, 3.0, 4.0, 5.0], {"width": 3, "partial": True, "skip_null": True}, [1, 2, 3.5, 4, 4.5]),
        ([1.0, N, 3.0, 4.0, 5.0], {"width": 3, "skip_null": True}, [N, 2, 3.5, 4, N]),
    ],
)
def test_moving_average(spark, x, kw, want):
    near(filters.moving_average(vector(spark, x), **kw).collect()["x"], want)


def test_moving_average_span(spark):
    sf = vector(spark, [10.0, 20.0, 30.0, 40.0, 50.0, 60.0], [0, 1, 3, 6, 10, 11])
    near(filters.moving_average(sf, span=2, partial=True).collect()["x"], [15, 15, 30, 40, 55, 55])


def test_chunks_equal_the_whole(spark):
    rng = random.Random(3)
    x = [rng.random() if rng.random() > 0.1 else N for _ in range(200)]
    for width in (4, 9):
        whole = filters.moving_average(vector(spark, x), width=width, partial=True, skip_null=True).collect()["x"]
        near(filters.moving_average(vector(spark, x), width=width, partial=True, skip_null=True, chunk_rows=13).collect()["x"], whole)


def test_rows_are_numbered_by_ranges(spark):
    df = spark.range(0, 5000, 1, 7).selectExpr("(id * 7919) % 5000 as t", "cast(id as double) as x")
    sf = SignalFrame.from_df(df, "t", "x", checks=False, parallel=True)
    assert sf.df.where("t <> _i").count() == 0 and sf.df.count() == 5000


@pytest.mark.parametrize(
    ("x", "kw", "want"),
    [
        ([1.0, 2.0, 999.0, 4.0, 999.0, 6.0], {"invalid_values": [999], "width": 3}, [1, 2, 3, 4, 5, 6]),
        ([1.0, 999.0, 3.0, -1.0, 5.0, 999.0], {"invalid_values": [999, -1], "width": 3}, [1, 2, 3, 4, 5, 5]),
        ([1.0, 5.0, 9.0], {"invalid_above": 9, "invalid_below": 1, "method": "none"}, [N, 5, N]),
    ],
)
def test_replace_invalid(spark, x, kw, want):
    near(rep.replace_invalid(vector(spark, x), **kw).collect()["x"], want)


@pytest.mark.parametrize(
    ("x", "kw", "want"),
    [
        ([N, 2.0, N, 4.0, N], {}, [2, 2, 3, 4, 4]),
        ([1.0, N, N, 4.0], {}, [1, 2, 3, 4]),
        ([1.0, 2.0, N, N, 5.0], {"method": "locf"}, [1, 2, 2, 2, 5]),
        ([N, N, 3.0, 4.0], {"method": "locf"}, [3, 3, 3, 4]),
        ([1.0, 2.0, N, 4.0, 5.0, N, 7.0], {"method": "median", "width": 3}, [1, 2, 3, 4, 5, 6, 7]),
        ([N, 2.0, N, 4.0, 5.0, N, 7.0], {"method": "median", "span": 2}, [2, 2, 3, 4, 5, 6, 7]),
        ([N, N, N], {}, [N, N, N]),
        ([float("nan"), 1.0, float("inf"), 3.0], {}, [1, 1, 2, 3]),
    ],
)
def test_replace_missing(spark, x, kw, want):
    near(rep.replace_missing(vector(spark, x), **kw).collect()["x"], want)


def test_replace_outliers(spark):
    x = [1.0, 2.0, 3.0, 100.0, 5.0]
    near(rep.replace_outliers(vector(spark, x), width=3, method="none").collect()["x"], [1, 2, 3, N, 5])
    near(rep.replace_outliers(vector(spark, x), width=3).collect()["x"], [1, 2, 3, 5, 5])
    near(rep.replace_outliers(vector(spark, [5.0] * 6), width=3).collect()["x"], [5] * 6)


def _median(v):
    v = sorted(v)
    return None if not v else (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2


def test_outliers_against_a_loop(spark):
    rng = random.Random(9)
    x = [rng.gauss(0, 1) if rng.random() > 0.1 else N for _ in range(120)]
    x = [v if v is None or rng.random() > 0.08 else v + 30 for v in x]
    known = [v for v in x if v is not None]
    least = min(d for d in (abs(b - a) for a, b in zip(known, known[1:], strict=False)) if d > 1e-5)
    want = []
    for i, v in enumerate(x):
        w = [u for u in x[max(0, i - 3) : i + 5] if u is not None]
        med = _median(w)
        mad = _median([abs(u - med) for u in w]) if w else None
        want.append(N if v is not None and abs(v - med) > least and abs(v - med) > 1.4826 * 2 * mad else v)
    near(rep.replace_outliers(vector(spark, x), outlier_cutoff=2, width=8, method="none").collect()["x"], want)


def test_replace_runs_its_steps_in_order(spark):
    sf = vector(spark, [1.0, 2.0, 50.0, N, 5.0, 6.0, 7.0, 8.0])
    near(sf.replace(outlier_cutoff=3, width=3, invalid_above=40).collect()["x"], [1, 2, 3, 4, 5, 6, 7, 8])
    with pytest.raises(SignalError, match="no replacement criteria"):
        sf.replace(method="none")


def test_resample(spark):
    sf = vector(spark, [10.0, 20.0, 30.0], [0, 1, 2])
    near(sf.resample(sample_rate=1, resample_rate=4, method="linear", verbose=False).collect()["x"], [10 + 2.5 * i for i in range(9)])
    t = [v / 10 + 0.1 for v in [1, 2, 2, *range(3, 10), 9, *range(10, 18), 17, *range(18, 22)]]
    sf = vector(spark, [float(v) for v in range(10, 10 + len(t))], t)
    x = sf.resample(resample_rate=10, method="linear", verbose=False).collect()["x"]
    near([x[1], x[8], x[16]], [11.5, 19.5, 28.5])
    x = sf.resample(resample_rate=10, verbose=False).collect()["x"]
    near([x[1], x[8], x[16]], [11, 19, 28])
    t = [v / 10 + 0.1 for v in [1, *range(3, 9), *range(10, 17), *range(18, 22)]]
    x = vector(spark, [float(v) for v in range(10, 10 + len(t))], t).resample(resample_rate=10, verbose=False).collect()["x"]
    assert [i + 1 for i, v in enumerate(x) if v is None] == [2, 9, 17]


def test_resample_labels(spark):
    def of(times, labels, rate):
        sf = SignalFrame.from_dict(spark, {"t": times, "v": [float(i) for i in range(len(times))], "c": labels}, time_channel="t", channels="v", checks=False)
        return sf.resample(resample_rate=rate, method="linear", verbose=False).collect()["c"]

    assert of([i * 0.5 for i in range(9)], ["A", N, N, N, "C", N, N, N, "E"], 1) == ["A", N, "C", N, "E"]
    assert of([0.0, 1.0, 2.0], ["A", "B", "C"], 2) == ["A", "A", "B", "B", "C"]
    assert of([0.0, 1.0, 2.0], ["A", N, "C"], 2) == ["A", "A", N, N, "C"]


def test_shift(spark):
    sf = vector(spark, [70.0] + [100.0] * 59, range(60))
    near([sf.shift(to=0.0, width=11).collect()["x"][0]], [70 - 1070 / 11])
    near([sf.shift(to=0.0, span=10).collect()["x"][0]], [70 - 770 / 8])
    near(sf.shift(by=1.0).collect()["x"][:2], [71, 101])
    with pytest.raises(SignalError, match="shift value undefined"):
        sf.shift(width=3)


def test_rescale(spark):
    sf = SignalFrame.from_dict(spark, {"A": [0.0, 50.0, 100.0], "B": [25.0, 25.0, 50.0], "C": [7.0, 7.0, 7.0]}, channels=["A", "B"], checks=False)
    got = sf.rescale(range=(0, 1)).collect()
    near(got["A"] + got["B"], [0, 0.5, 1, 0.25, 0.25, 0.5])
    near(sf.rescale(channels="C", range=(0, 1)).collect()["C"], [7, 7, 7])
    got = sf.rescale(group_channels="distinct", range=(0, 10)).collect()
    near(got["B"], [0, 0, 10])


def test_filters(spark):
    near(filters.butterworth(vector(spark, [5.0] * 50), order=1, W_=0.5).collect()["x"], [5] * 50)
    rng = random.Random(1)
    noisy = [rng.gauss(0, 1) for _ in range(200)]
    spread = lambda v: sum(a * a for a in v)
    sf = vector(spark, noisy)
    low = sf.filter(method="butter", W_=0.1, verbose=False).collect()["x"]
    assert spread(low) < spread(noisy) / 3
    rough, smooth = (spread([b - a for a, b in zip(y, y[1:], strict=False)]) for y in (sf.filter(method="spline", spar=s, verbose=False).collect()["x"] for s in (0.3, 1.0)))
    assert smooth < rough
    with pytest.raises(SignalError, match="cutoff frequency undefined"):
        sf.filter(method="butterworth", verbose=False)
    holes = vector(spark, [1.0, N, 3.0, 4.0, 5.0], checks=True)
    with pytest.raises(SignalError, match="contain nulls"):
        holes.filter(method="spline", verbose=False)
    assert holes.filter(method="spline", skip_null=True, spar=0.5, verbose=False).collect()["x"][1] is None


def test_butterworth_design():
    for kind, w in (("low", 0.3), ("high", 0.3), ("pass", (0.2, 0.4)), ("stop", (0.2, 0.4))):
        b, a = kernels.butterworth(2, w, kind)
        import numpy as np

        gain = lambda f: abs(np.polyval(b, np.exp(1j * np.pi * f)) / np.polyval(a, np.exp(1j * np.pi * f)))  # noqa: B023, E731
        passes = {"low": 0.0, "high": 1.0, "pass": None, "stop": 0.0}[kind]
        if passes is not None:
            assert abs(gain(passes) - 1) < 1e-9
        for edge in w if isinstance(w, tuple) else (w,):
            assert abs(gain(edge) - 0.5**0.5) < 1e-9


def test_many_series_equal_each_alone(spark):
    rng = random.Random(5)
    parts = {f"s{k}": vector(spark, [rng.random() if rng.random() > 0.2 else N for _ in range(30)]) for k in range(3)}
    both = SignalFrame.union(parts)
    shuffled = SignalFrame(both.df.repartition(7), both.meta, False)
    for verb in (
        lambda f: f.replace(outlier_cutoff=2, width=5),
        lambda f: f.replace(method="median", width=4),
        lambda f: f.resample(resample_rate=2.5, method="linear", verbose=False),
        lambda f: f.replace().filter(method="ma", width=3, partial=True),
        lambda f: f.shift(to=1.0, width=3),
        lambda f: f.rescale(range=(0, 1)),
    ):
        out = verb(shuffled)
        for name, alone in parts.items():
            near(out.collect(name)["x"], verb(alone).collect()["x"])


def test_ties_are_filled_by_time(spark):
    rng = random.Random(7)
    t = [rng.choice([0.0, -0.0, 1.0, 2.0, 4.0, 8.0, N, float("nan")]) for _ in range(60)]
    rows = [(f"s{k % 3}", k, t[k], rng.random() if rng.random() > 0.6 else N, N if k % 3 else 1.5) for k in range(60)]
    df = spark.createDataFrame(rows, "series string, _i long, t double, x double, y double")
    sf = SignalFrame(df, SignalMeta().with_(channels=("x", "y"), time_channel="t"), False)
    for method in ("linear", "locf"):
        one, other = (sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in rep.replace_missing(sf, method=method, by_time=b).df.collect()) for b in (False, True))
        assert one == other and len(one) == 60


def test_no_task_holds_a_series_of_tied_rows(spark):
    from oxyframe.plans import catalog

    plan = catalog.replace_missing_tied_times(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # Orders themselves go through no window: only what is aggregated by series and time does.
    assert "row_number" not in plan and plan.count("Window [") == 2 and "Aggregate [" in plan


def test_kernels_side_by_side_equal_each_alone():
    rng = np.random.default_rng(3)
    series = [(np.sort(rng.uniform(0, 9, n)), rng.normal(size=n)) for n in (1, 2, 3, 4, 5, 64, 64, 64, 5, 9000, 3)]
    for spar in (0.2, 0.6, 1.1):
        for got, (t, y) in zip(kernels.smoothed(series, spar), series, strict=True):
            assert np.array_equal(got, kernels.Spline(t, y).fit(spar)[0])
    b, a = kernels.butterworth(2, (0.1, 0.4), "pass")
    for edges in filters.EDGES:
        for steady in (False, True):
            for got, (_, x) in zip(kernels.filtered([x for _, x in series], b, a, edges, steady), series, strict=True):
                assert np.array_equal(got, kernels.both_ways(b, a, x, edges, steady))


def test_series_are_whole_whatever_the_batches():
    import pyarrow as pa

    keys = ["a"] * 7 + ["b"] + [None] * 3 + ["c"] * 20 + ["d", "e", "e"]
    whole = [(k, [i for i, x in enumerate(keys) if x == k]) for k in dict.fromkeys(keys)]
    for size in (1, 2, 3, 5, 8, 40):
        batches = [pa.RecordBatch.from_pydict({"series": pa.array(keys[i : i + size], pa.string()), "n": list(range(len(keys)))[i : i + size]}) for i in range(0, len(keys), size)]
        for rows in (1, 4, 9, 100):
            got = []
            for table, edge in filters._whole_series(iter([batches[0].slice(0, 0), *batches]), rows):
                assert edge[0] == 0 and edge[-1] == len(table)
                got += [(table["series"][int(i)].as_py(), table["n"][int(i) : int(j)].to_pylist()) for i, j in zip(edge[:-1], edge[1:], strict=True)]
            assert got == whole
    assert list(filters._whole_series(iter([]), 5)) == []


def test_short_series_are_filtered_together(spark):
    rng = random.Random(4)
    parts = {f"s{k}": vector(spark, [rng.random() if rng.random() > 0.2 else N for _ in range(3 + 9 * k)]) for k in range(4)}
    parts["none"] = SignalFrame(parts["s0"].df.selectExpr("series", "_i", "t", "cast(null as double) as x"), parts["s0"].meta, False)
    both = SignalFrame.union(parts)
    shuffled = SignalFrame(both.df.repartition(7), both.meta, False)
    for verb in (lambda f: f.filter(method="spline", spar=0.5, skip_null=True, verbose=False), lambda f: f.filter(method="butterworth", W_=0.3, skip_null=True, verbose=False)):
        out = verb(shuffled)
        assert "FlatMapGroups" not in out.df._jdf.queryExecution().optimizedPlan().toString()
        for name, alone in parts.items():
            near(out.collect(name)["x"], verb(alone).collect()["x"])


def test_conditions(spark):
    with pytest.raises(SignalError, match="window size undefined"):
        filters.moving_average(vector(spark, [1.0, 2.0]))
    with pytest.raises(SignalError, match="insufficient valid samples"):
        filters.moving_average(vector(spark, [1.0, 2.0, 3.0], checks=True), width=9, verbose=False)
    with pytest.raises(SignalError, match="not sorted"):
        filters.moving_average(vector(spark, [1.0, 2.0, 3.0], [0, 2, 1], checks=True), span=2, partial=True, verbose=False)
    with pytest.raises(SignalError, match="not found"):
        vector(spark, [1.0, 2.0]).channel_names("nope")
    with pytest.warns(SignalWarning, match="contain nulls"):
        filters.moving_average(vector(spark, [1.0, N, 3.0, 4.0], checks=True), width=2)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        filters.moving_average(vector(spark, [1.0, 2.0, 3.0, 4.0], checks=True), width=2)


def test_long_series_in_blocks_are_exact():
    rng = np.random.default_rng(2)
    for n in (100, 8192, 20011):
        x = np.cumsum(rng.normal(size=n))
        for order, cutoff, kind in ((2, 0.1, "low"), (4, (0.05, 0.3), "pass"), (1, 0.5, "high")):
            b, a = kernels.butterworth(order, cutoff, kind)
            for steady in (False, True):
                plain = kernels.recurse(b, a, x, steady, long=1 << 60)
                assert np.allclose(kernels.recurse(b, a, x, steady, long=64), plain, rtol=1e-7, atol=1e-7)


@pytest.mark.parametrize("n", [3, 4, 5, 12, 64])
def test_spline_against_dense_matrices(n):
    """The banded system against the same minimisation with whole matrices, and its choice of spar against a fine grid."""
    rng = np.random.default_rng(n)
    t = np.sort(rng.uniform(0, 9, n))
    y = np.sin(t) + rng.normal(size=n) / 4
    h = np.diff((t - t[0]) / (t[-1] - t[0]))
    q, r = np.zeros((n, n - 2)), np.zeros((n - 2, n - 2))
    for j in range(n - 2):
        q[j : j + 3, j] = 1 / h[j], -1 / h[j] - 1 / h[j + 1], 1 / h[j + 1]
        r[j, j] = (h[j] + h[j + 1]) / 3
        if j:
            r[j, j - 1] = r[j - 1, j] = h[j] / 6
    spline = kernels.Spline(t, y)

    def dense(s):
        lam = spline.ratio * 256 ** (3 * s - 1)
        return np.eye(n) - lam * q @ np.linalg.solve(r + lam * q.T @ q, q.T)

    for s in (-0.4, 0.0, 0.3, 0.7, 1.1):
        assert np.allclose(spline.fit(s)[0], dense(s) @ y, atol=1e-8)
        assert np.isclose(spline._solve(np.array([spline.ratio * 256 ** (3 * s - 1)]))[1][0], n - np.trace(dense(s)), atol=1e-6)
    if n >= 12:
        score = lambda s: (((dense(s) - np.eye(n)) @ y) ** 2).sum() / (n - np.trace(dense(s))) ** 2
        fit, chosen = spline.fit()
        assert score(chosen) <= min(map(score, np.arange(-1.4, 1.5, 0.02))) + 1e-9 and np.allclose(fit, dense(chosen) @ y, atol=1e-8)
