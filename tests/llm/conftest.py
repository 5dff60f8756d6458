import pytest

from oxyframe.llm import spread

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text) pairs, in several partitions."""

    def make(rows, extra=""):
        full = [(d, t, "en", "s", None if t is None else len(t), *([0] * extra.count("long"))) for d, t in rows]
        return spark.createDataFrame(full, DOCS + extra).repartition(3)

    return make


@pytest.fixture
def small(spark):
    return lambda name: spread.table(spark, "/root/testdata/sf0.001", name)
