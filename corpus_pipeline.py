"""From raw documents to token ids: five stages, each written and read again.

Every stage takes (spark, docs, sf_dir), works on all that the stage before kept and
returns a DataFrame; all but the last return the columns of ``documents``.

Edge cases, stage by stage as the operators state them: null texts count as empty and
are empty after line dedup; rows without an id are never copies of others and
keep all their lines; of rows that repeat an id one stays; other columns pass through,
whatever their names; an empty table passes every stage. The last stage gives a row for
each document left. What lies between the stages is removed when the driver ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oxyframe.llm import decontaminate, line_dedup, near_dedup, pieces, quality
from oxyframe.llm.queries import PIECES
from oxyframe.llm.spread import folder, free, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents or more share stay in one of them; ``n_chars`` follows the text."""
    counts = tuple(free(docs, "_n_lines", "_n_dropped"))
    done = line_dedup.line_dedup(docs, counts=counts).drop(*counts)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return near_dedup.keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and whether decoding gives the text back."""
    return pieces.encode(docs, PIECES).select("doc_id", "n_chars", "n_tokens", "ids", "ids_sha256", "round_trip")


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", lines_once),
    ("near dedup", one_of_each),
    ("decontamination", uncontaminated),
    ("sentencepiece", token_ids),
]

#: SQL expresses neither the classifier nor sampling, alignment and pieces; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    base = folder(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{base}/{k}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
