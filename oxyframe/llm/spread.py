"""Reading tables, and keeping state in shared storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, folder, shared_dir, ship

__all__ = ["apart", "cut", "folder", "free", "gathered", "shared_dir", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as a table and read from there."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


ROWS_A_PART = 50_000  # short rows that make a partition worth its task


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of at most so many short rows, in the partitions they need: two a core, or more where the rows are many."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_PART)))


def apart(doc_id: str = "doc_id") -> tuple[Column, Column]:
    """Two join keys of a document: its id and 0, or where that is null a number of the row's own.

    Rows without an id match nothing and are dealt over all tasks.
    """
    doc = F.col(doc_id).cast("long")
    return F.coalesce(doc, F.lit(0)), F.when(doc.isNull(), F.monotonically_increasing_id() + 1).otherwise(0)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out
