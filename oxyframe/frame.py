"""SignalFrame: a long DataFrame of recordings with roles.

Every recording is a ``series``; ``_i`` is a row's place in it, from 0. Verbs return
new frames and stay lazy but for checks, which cost one small aggregate and are
skipped with ``checks=False``.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .args import column_names
from .errors import SignalError, inform, warn
from .functions import windows as W
from .meta import SignalMeta
from .session import cut

SERIES, ROW = W.SERIES, W.ROW


def numbered(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Rows numbered from 0 in the order given, by ranges: no task holds them all.

    The ranges are written before they are counted, as a repeated run may cut others.
    What goes through the driver is one count a range.
    """
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = sorted(tuple(r) for r in ranged.groupBy(part.alias("p")).count().collect())
    before = list(itertools.accumulate((n for _, n in counts), initial=0))
    starts = df.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(counts, before, strict=False)], "_part long, _before long")
    joined = ranged.join(F.broadcast(starts), part == F.col("_part"))
    return joined.withColumn(ROW, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_before")


class MixedRates(SignalError):
    """Series have several rates: the rates, and the table of series and rate."""

    def __init__(self, rates: list[float], table: DataFrame):
        super().__init__(f"series have several sample rates: {', '.join(f'{r:g}' for r in rates)} Hz")
        self.rates, self.table = rates, table


def each_rate(verb):
    """A verb that takes the series of each estimated rate by themselves."""

    @functools.wraps(verb)
    def run(sf: SignalFrame, *args: Any, **kw: Any) -> SignalFrame:
        try:
            return verb(sf, *args, **kw)
        except MixedRates as mixed:
            done = [verb(part, *args, **kw) for part in sf.parts(mixed)]
            changes: dict[str, Any] = {"sample_rate": None}
            if done[0].meta.interval_times is not None:
                changes["interval_times"] = functools.reduce(lambda a, b: a.unionByName(b), [f.meta.interval_times for f in done])
            df = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.df for f in done])
            return SignalFrame(df, done[0].meta.with_(**changes), sf.checks)

    return run


class SignalFrame:
    """Recordings and their metadata."""

    def __init__(self, df: DataFrame, meta: SignalMeta, checks: bool = True, lone: bool = False):
        self.df, self.meta, self.checks = df, meta, checks
        self.lone = lone  # known to be one recording

    # Construction

    @staticmethod
    def from_df(df: DataFrame, time_channel: str | None = None, channels: Any = None, event_channel: str | None = None, series: str | Sequence[str] | None = None, order: str | Sequence[str | Column] | None = None, checks: bool = True, parallel: bool = False, **meta: Any) -> SignalFrame:
        """A frame from any DataFrame.

        ``series`` names the key columns (joined with ``_``; kept); without it all rows
        are one recording, ``interval_1``. Rows are in the order given, else by time. One
        recording too long for a task is numbered in ``parallel``.
        """
        if not df.columns:
            raise SignalError("data needs a column at least", "from_df")
        keys = [series] if isinstance(series, str) else list(series or [])
        key = F.concat_ws("_", *[F.col(W.q(k)).cast("string") for k in keys]) if keys else F.lit("interval_1")
        by = [order] if isinstance(order, (str, Column)) else list(order or ([time_channel] if time_channel else []))
        if not by and ROW not in df.columns:
            by = [F.monotonically_increasing_id()]
        df = df.withColumn(SERIES, key)
        if by and parallel and not keys:
            df = numbered(df, by)
        elif by:
            df = df.withColumn(ROW, (F.row_number().over(Window.partitionBy(SERIES).orderBy(*by)) - 1).cast("long"))
        return SignalFrame(df, SignalMeta().with_(time_channel=time_channel, channels=column_names(channels, df.columns), event_channel=event_channel, **meta), checks, lone=not keys)

    @staticmethod
    def from_dict(spark, data: dict[str, list], types: dict[str, str] | None = None, **roles: Any) -> SignalFrame:
        """One recording from lists, in their order."""
        guess = {int: "bigint", str: "string", bool: "boolean"}
        kinds = {k: (types or {}).get(k) or next((guess.get(type(x), "double") for x in v if x is not None), "double") for k, v in data.items()}
        rows = [(*r, i) for i, r in enumerate(zip(*data.values(), strict=True))]
        coerce = [float if kinds[k] == "double" else (lambda x: x) for k in data]
        rows = [(*[None if x is None else f(x) for x, f in zip(r, coerce, strict=False)], r[-1]) for r in rows]
        schema = ", ".join([*(f"{W.q(k)} {t}" for k, t in kinds.items()), f"{ROW} bigint"])
        df = spark.createDataFrame(rows, schema)
        return SignalFrame.from_df(df, order=ROW, **roles)

    @staticmethod
    def union(frames: dict[str, SignalFrame] | Sequence[SignalFrame]) -> SignalFrame:
        """Several recordings as one frame; unnamed ones are ``interval_<n>``, missing columns null."""
        named = frames if isinstance(frames, dict) else {f"interval_{i + 1}": f for i, f in enumerate(frames)}
        if not named:
            raise SignalError("no frames to join", "union")
        out, meta = None, next(iter(named.values())).meta
        for name, f in named.items():
            part = f.df.withColumn(SERIES, F.lit(name))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
            meta = meta.with_(channels=(*meta.channels, *f.meta.channels))
        return SignalFrame(out, meta, all(f.checks for f in named.values()))

    def with_meta(self, **changes: Any) -> SignalFrame:
        """Metadata over that of the frame."""
        if "channels" in changes:
            changes["channels"] = column_names(changes["channels"], self.df.columns)
        return SignalFrame(self.df, self.meta.with_(**changes), self.checks, self.lone)

    def _new(self, df: DataFrame, **changes: Any) -> SignalFrame:
        return SignalFrame(df, self.meta.with_(**changes), self.checks, self.lone)

    def _several(self) -> SignalFrame:
        self.lone = False
        return self

    # Roles

    @property
    def data_columns(self) -> list[str]:
        return [c for c in self.df.columns if c not in (SERIES, ROW)]

    def _need_columns(self, n: int, func: str) -> None:
        if len(self.data_columns) < n:
            raise SignalError(f"data needs {n} columns at least", func)

    def channel_names(self, channels: Any = None, func: str = "channels") -> list[str]:
        """Channels asked for, else those of the metadata; they exist, are numeric and have two finite values."""
        names = column_names(channels, self.df.columns) or list(self.meta.channels)
        if not names:
            raise SignalError("no channels given, and none in the metadata", func)
        self._exist(names, func)
        for c in names:
            if not isinstance(self.df.schema[c].dataType, T.NumericType):
                raise SignalError(f"channel {c} must be numeric", func)
        self._finite(names, func)
        return names

    def time_name(self, time_channel: Any = None, func: str = "time") -> str:
        names = column_names(time_channel, self.df.columns) or ([self.meta.time_channel] if self.meta.time_channel else [])
        if len(names) != 1:
            raise SignalError("give one time channel", func)
        self._exist(names, func)
        if not isinstance(self.df.schema[names[0]].dataType, T.NumericType):
            raise SignalError(f"time channel {names[0]} must be numeric", func)
        self._finite(names, func)
        return names[0]

    def event_name(self, event_channel: Any = None, required: bool = True, func: str = "event") -> str | None:
        names = column_names(event_channel, self.df.columns) or ([self.meta.event_channel] if self.meta.event_channel else [])
        if not names:
            if required:
                raise SignalError("an event channel is required", func)
            return None
        self._exist(names, func)
        kind = self.df.schema[names[0]].dataType
        if not isinstance(kind, (T.StringType, T.NumericType)):
            raise SignalError(f"event channel {names[0]} must hold labels or whole numbers", func)
        if self.checks:
            c = F.col(W.q(names[0]))
            some = c.isNotNull() & (c != "" if isinstance(kind, T.StringType) else F.lit(True))
            odd = F.lit(False) if isinstance(kind, T.StringType) else c != F.floor(c)
            n, bad = self.df.agg(F.count(F.when(some, 1)), F.count(F.when(odd, 1))).first()
            if not n:
                raise SignalError(f"event channel {names[0]} holds no events", func)
            if bad:
                raise SignalError(f"event channel {names[0]} must hold labels or whole numbers", func)
        return names[0]

    def _exist(self, names: Sequence[str], func: str) -> None:
        if missing := [c for c in names if c not in self.df.columns]:
            raise SignalError(f"column(s) {', '.join(missing)} not found", func)

    def _finite(self, names: Sequence[str], func: str) -> None:
        if self.checks:
            row = self.df.agg(*[F.expr(f"count({W.clean(c)})") for c in names]).first()
            if poor := [c for c, n in zip(names, row, strict=True) if n < 2]:
                raise SignalError(f"column(s) {', '.join(poor)} need two finite values at least", func)

    # Time

    def check_sorted(self, time: str, func: str) -> None:
        """Times are present and never fall within a series."""
        if self.checks:
            before = f"lag({W.q(time)}) OVER (PARTITION BY {SERIES} ORDER BY {ROW})"
            if not self.df.select(F.expr(f"{W.q(time)} is null or {W.q(time)} < {before}").alias("bad")).where("bad").isEmpty():
                raise SignalError("irregular time: values are missing or not sorted", func)

    def estimated_rates(self, time_channel: Any = None) -> DataFrame:
        """series, rate: for each series 1 / the median step of its time, as the nearest usual rate; null without two times."""
        t = self.time_name(time_channel, "estimated_rates")
        step = self.df.select(SERIES, F.expr(f"{W.q(t)} - lag({W.q(t)}) OVER (PARTITION BY {SERIES} ORDER BY {ROW})").alias("d"))
        middle = step.groupBy(SERIES).agg(F.expr("1 / nullif(percentile(d, 0.5), 0)").alias("r"))
        return middle.selectExpr(SERIES, f"case when r is not null then {W.snapped_sql('r')} end as rate")

    def estimated_rate(self, time_channel: Any = None) -> float:
        """The estimate that all series share; MixedRates where they differ."""
        table = self.estimated_rates(time_channel)
        found = sorted(r.rate for r in table.where("rate is not null").select("rate").distinct().collect())
        if not found:
            raise SignalError("sample rate cannot be estimated")
        if len(found) > 1:
            raise MixedRates(found, table)
        return float(found[0])

    def parts(self, mixed: MixedRates) -> list[SignalFrame]:
        """The series of each rate, with that rate; a series without an estimate goes with the lowest."""
        rate = F.coalesce("rate", F.lit(mixed.rates[0]))
        of = [self.df.join(mixed.table.where(rate == r).select(SERIES), SERIES, "left_semi").select(*map(W.q, self.df.columns)) for r in mixed.rates]
        return [SignalFrame(df, self.meta.with_(sample_rate=r), self.checks) for df, r in zip(of, mixed.rates, strict=True)]

    def rate(self, sample_rate: float | None = None, time_channel: Any = None, verbose: bool = True, func: str = "rate") -> float:
        """The rate given, else that of the metadata, else an estimate (MixedRates where series differ)."""
        from .args import number

        number("sample_rate", sample_rate, 1, 0, inclusive=(False, True), func=func)
        known = sample_rate if sample_rate is not None else self.meta.sample_rate
        if known is None:
            known = self.estimated_rate(time_channel)
            inform(f"estimated sample rate is {known:g} Hz", func, verbose)
        elif self.checks and sample_rate is not None and abs(known - 1) > 0.5:
            try:
                guesses = [self.estimated_rate(time_channel)]
            except MixedRates as mixed:
                guesses = mixed.rates
            if odd := [f"{g:g}" for g in guesses if abs(g - known) > 0.5]:
                warn(f"sample rate {known:g} Hz differs from the estimate {', '.join(odd)} Hz", func, verbose)
        return float(known)

    def irregular_samples(self, time_channel: Any = None, gap: float = 3600.0) -> DataFrame:
        """Rows whose time repeats, falls, or comes a gap or more after the row before."""
        t = W.q(self.time_name(time_channel, "irregular_samples"))
        return self.df.selectExpr(
            SERIES, ROW, f"{t} as time",
            f"count(*) OVER (PARTITION BY {SERIES} ORDER BY {t} RANGE BETWEEN CURRENT ROW AND CURRENT ROW) > 1 as repeated",
            f"coalesce({t} - lag({t}) OVER (PARTITION BY {SERIES} ORDER BY {ROW}) < 0, false) as falls",
            f"coalesce({t} - lag({t}) OVER (PARTITION BY {SERIES} ORDER BY {ROW}) >= {gap!r}D, false) as gap",
        ).where("repeated or falls or gap")

    # Verbs

    def replace(self, **kw: Any) -> SignalFrame:
        from .operators.replace import replace

        return replace(self, **kw)

    def resample(self, **kw: Any) -> SignalFrame:
        from .operators.resample import resample

        return resample(self, **kw)

    def filter(self, **kw: Any) -> SignalFrame:
        from .operators.filters import filter_channels

        return filter_channels(self, **kw)

    def shift(self, **kw: Any) -> SignalFrame:
        from .operators.shift import shift

        return shift(self, **kw)

    def rescale(self, **kw: Any) -> SignalFrame:
        from .operators.rescale import rescale

        return rescale(self, **kw)

    def extract_intervals(self, **kw: Any) -> SignalFrame:
        from .operators.intervals import extract_intervals

        return extract_intervals(self, **kw)

    # Output

    def collect(self, name: str | None = None) -> dict[str, list]:
        """One small recording as lists, in order."""
        df = self.df if name is None else self.df.where(F.col(SERIES) == name)
        rows = df.orderBy(SERIES, ROW).collect()
        return {c: [r[c] for r in rows] for c in self.data_columns}

    def names(self) -> list[str]:
        return sorted(r[0] for r in self.df.select(SERIES).distinct().collect())

    def as_dict(self) -> dict[str, SignalFrame]:
        """A frame for each series."""
        return {n: self._new(self.df.where(F.col(SERIES) == n)) for n in self.names()}

    def write(self, path: str, mode: str = "error") -> None:
        """Parquet with roles in the fields' metadata."""
        role = {**{c: "channel" for c in self.meta.channels}, self.meta.time_channel: "time", self.meta.event_channel: "event"}
        extra = {"sample_rate": self.meta.sample_rate, "device": self.meta.device}
        cols = [F.col(W.q(c)).alias(c, metadata={"role": role.get(c, "other"), **{k: v for k, v in extra.items() if v is not None}}) for c in self.df.columns]
        self.df.select(*cols).write.mode(mode).parquet(path)

    @staticmethod
    def read(spark, path: str) -> SignalFrame:
        """What ``write`` wrote."""
        df = spark.read.parquet(path)
        of = {r: [f.name for f in df.schema if f.metadata.get("role") == r] for r in ("channel", "time", "event")}
        first = df.schema[0].metadata
        return SignalFrame(df, SignalMeta().with_(channels=of["channel"], time_channel=(of["time"] or [None])[0], event_channel=(of["event"] or [None])[0], sample_rate=first.get("sample_rate"), device=first.get("device")))

    def __repr__(self) -> str:
        return f"SignalFrame[{', '.join(self.data_columns)}] {self.meta}"
