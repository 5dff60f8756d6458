"""The driver tables as recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import ROW, SERIES, SignalFrame
from ..meta import SignalMeta
from ..session import ship

# A deterministic mix of spikes and gaps for the cleaning verbs.
DIRTY = "case when (i + vec_id) % 13 = 5 then 9.5D when (i + vec_id) % 11 = 3 then null else x end"
EVENT = "case when i = 10 + vec_id % 5 then 'start' when i = 40 + vec_id % 7 then 'end' else '' end"


def sample(embedding: str, f: str, i: str) -> str:
    """A sample of ``vectors`` as a struct, from its place ``i`` (from 0) and value ``f`` in the array."""
    x, y = f"cast({f} as double)", f"cast({embedding}[size({embedding}) - 1 - {i}] as double)"
    z = DIRTY.replace("(i + vec_id)", f"({i} + vec_id)").replace("else x end", f"else {x} end")
    return f"named_struct('i', {i}, 'x', {x}, 'y', {y}, 'z', {z}, 'lap', cast({i} div 8 + 1 as int))"


def micros(stamp: str) -> str:
    """Microseconds since 1970 of a timestamp's own calendar reading, with or without time zone."""
    return f"(unix_date(cast({stamp} as date)) * 86400000000L + (hour({stamp}) * 3600L + minute({stamp}) * 60L) * 1000000L + cast(extract(second from {stamp}) * 1000000 as bigint))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> SignalFrame:
    """Each embedding as a 10 Hz recording: x, y (reversed), z (x with spikes and gaps), ev, lap."""
    e = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "size(embedding) as n", "embedding", "posexplode(embedding) as (i, f)")
    df = e.selectExpr(
        f"cast(vec_id as string) as {SERIES}", f"cast(i as bigint) as {ROW}", "vec_id", "i", "cast(i as double) / 10 as t", "cast(f as double) as x", "cast(embedding[n - 1 - i] as double) as y",
    ).selectExpr("*", f"{DIRTY} as z", f"{EVENT} as ev", "cast(i div 8 + 1 as int) as lap")
    return SignalFrame(df, SignalMeta().with_(channels=("x",), time_channel="t", event_channel="ev", sample_rate=10.0), checks=False)


def users(spark: SparkSession, sf_dir: str) -> SignalFrame:
    """Each user's events as a recording in seconds since the user's first."""
    e = table(spark, sf_dir, "events").selectExpr("user_id", f"{micros('ts')} as us", "value", "event_type")
    df = e.selectExpr(
        f"cast(user_id as string) as {SERIES}", f"row_number() over (partition by user_id order by us) - 1L as {ROW}", "user_id",
        "cast(us - min(us) over (partition by user_id) as double) / 1000000 as t", "value", "event_type",
    )
    return SignalFrame(df, SignalMeta().with_(channels=("value",), time_channel="t", event_channel="event_type"), checks=False)


def out(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Named columns; doubles are rounded and never negative zero."""
    picked = df.selectExpr(*columns)
    return picked.select(*[(F.round(F.col(f"`{n}`"), digits) + F.lit(0.0)).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in picked.dtypes])
