import math

import pytest

from oxyframe import args
from oxyframe.errors import SignalError, SignalWarning
from oxyframe.frame import SERIES, MixedRates, SignalFrame
from oxyframe.operators import intervals as I  # noqa: E741


@pytest.fixture(scope="module")
def laps(spark):
    n = 100
    data = {
        "time": [i / 10 for i in range(n)],
        "l": [40.0 if i < 50 else 60.0 for i in range(n)],
        "r": [60.0 if i < 50 else 40.0 for i in range(n)],
        "event": [i // 10 + 1 for i in range(n)],
        "label": ["start" if i == 10 else "end" if i == 90 else "" for i in range(n)],
    }
    return SignalFrame.from_dict(spark, data, time_channel="time", channels=["l", "r"], event_channel="event", sample_rate=10.0)


def test_lap(laps):
    got = laps.extract_intervals(start=I.by_lap(2), end=I.by_lap(4), span=(0, 0), verbose=False).collect()
    assert (len(got["time"]), got["time"][0], got["time"][-1]) == (30, 1.0, 3.9)


def test_label_and_zero_time(laps):
    got = laps.extract_intervals(event_channel="label", start="start", end="end", span=(0, 0), zero_time=True, verbose=False).collect()
    assert (got["time"][0], len(got["time"])) == (0.0, 81)
    with pytest.raises(SignalError, match="no events detected"):
        laps.extract_intervals(event_channel="label", start="nothing", verbose=False)


def test_ensemble(laps):
    out = laps.extract_intervals(start=I.by_time(1.0, 6.0), span=(0, 2), group_intervals="ensemble", verbose=False)
    got = out.collect()
    assert out.names() == ["ensemble"] and out.data_columns == ["time", "l", "r"]
    assert set(got["l"]) == {50.0} and got["time"][0] == 0.0 and len(got["l"]) == 21


def test_groups(laps):
    out = laps.extract_intervals(start=I.by_time(1.0, 3.0, 6.0, 8.0), span=(0, 1), group_intervals=[[1, 3]], verbose=False)
    assert out.names() == ["interval_1_3", "interval_2", "interval_4"]
    assert I.interval_groups([[4, 5], [1]], 5, False) == [("interval_1", [1]), ("interval_2", [2]), ("interval_3", [3]), ("interval_4_5", [4, 5])]
    with pytest.raises(SignalError, match="outside 1..2"):
        I.interval_groups([[3]], 2)


def test_channels_of_groups(laps):
    out = laps.extract_intervals(start=I.by_time(1.0, 6.0), span=(0, 1), group_intervals="ensemble", group_channels=[["l"], ["l", "r"]], verbose=False)
    got = out.collect()
    assert set(got["l"]) == {50.0} and set(got["r"]) == {40.0}


def test_bounds(laps):
    with pytest.raises(SignalError, match="entirely outside"):
        laps.extract_intervals(start=I.by_time(100.0), span=(0, 1), verbose=False)
    with pytest.warns(SignalWarning, match="partially outside"):
        laps.extract_intervals(start=I.by_time(9.5), span=(0, 5))
    with pytest.raises(SignalError, match="no interval specification"):
        laps.extract_intervals()


def test_coercion():
    assert I.as_boundary(3).kind == "lap" and I.as_boundary(3.0).kind == "time" and I.as_boundary("x").kind == "label"
    assert I.span_pair(5) == (0.0, 5.0) and I.span_pair(-5) == (-5.0, 0.0) and I.span_pair((-1, 2)) == (-1.0, 2.0)


def test_channel_arguments():
    got = args.per_channel(["a", "b"], {"width": {"a": 3, None: 5}, "to": 1}, verbose=False)
    assert got == {"a": {"width": 3, "to": 1}, "b": {"width": 5, "to": 1}}
    groups = args.group_channels(["a", "b", "c"], {"g": ["a", "b"]})
    assert groups == {"g": ["a", "b"], "c": ["c"]}
    assert args.per_channel(["a", "b", "c"], {"to": {"g": 1, "c": 2}}, groups=groups)["c"]["to"] == 2
    with pytest.raises(SignalError, match="conflicting"):
        args.per_channel(["a", "b"], {"to": {"a": 1, "b": 2}}, groups={"g": ["a", "b"]})
    with pytest.raises(SignalError, match="more than one group"):
        args.group_channels(["a", "b"], [["a"], ["a", "b"]])
    with pytest.warns(SignalWarning, match="not recognised"):
        args.per_channel(["a"], {"to": {"z": 1, None: 2}})
    assert args.column_names(args.starts_with("a"), ["ab", "b"]) == ["ab"]


def test_series_of_several_rates(spark):
    """Each series is filtered and averaged by its own rate, as if it were alone."""
    def one(name, rate, n):
        return [(name, k, k / rate, 50 + 10 * math.sin(k / 3) + (k * 7919 % 13) / 10) for k in range(n)]

    rows = one("fast", 10.0, 200) + one("slow", 1.0, 50) + [("lone", 0, 0.0, 1.0)]
    frame = lambda rows: SignalFrame.from_df(spark.createDataFrame(rows, "s string, k long, t double, x double"), "t", ["x"], series="s", order="k")
    both = frame(rows)
    assert {r[0]: r.rate for r in both.estimated_rates().collect()} == {"fast": 10.0, "slow": 1.0, "lone": None}
    with pytest.raises(MixedRates):
        both.estimated_rate()
    smooth = {(r.s, r.k): r.x for r in frame(rows[:-1]).filter(method="butterworth", order=2, fc=0.2, verbose=False).df.collect()}
    for name, rate in (("fast", 10.0), ("slow", 1.0)):
        alone = frame([r for r in rows if r[0] == name]).filter(method="butterworth", order=2, fc=0.2, sample_rate=rate, verbose=False).df.collect()
        assert all(abs(smooth[name, r.k] - r.x) < 1e-9 for r in alone) and len(alone) > 40
    grid = frame(rows[:-1]).resample(method="linear", verbose=False).df.groupBy(SERIES).count().collect()
    assert sorted(r[1] for r in grid) == [50, 200]
