import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def small():
    """Rows that make trouble: nulls, empties, ties, repeated rows, a long text, a clashing extra column."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return [
        (1, "a b c d e f g h", "en", "s1", 5, "x"), (2, "a  b\tc d e f\n g h", "en", "s1", 5, "x"), (3, None, None, None, None, None),
        (4, "", "en", "s2", 0, "y"), (5, " ", "en", "s2", 1, "y"), (6, long, "fr", "s1", len(long), "z"), (7, long + " end", "fr", "s1", len(long) + 4, "z"),
        (8, "Ünïcödé — 日本語 text 🙂", "de", "s3", 20, "u"), (8, "Ünïcödé — 日本語 text 🙂", "de", "s3", 20, "u"), (None, "no id at all here", "en", None, 4, "n"),
        (10, "one", "en", "s1", 3, "o"), (11, "it's 12 o'clock<|endoftext|>now", "en", "s1", 31, "p")]


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.createDataFrame(small, "doc_id long, text string, lang string, source string, n_chars long, kept string")


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def texts(spark, sf_dir):
    """The smallest documents table as plain rows."""
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
