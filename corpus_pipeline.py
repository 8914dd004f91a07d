"""The training-data pipeline: five stages over ``documents``, each a table written as Parquet and read by the next.

Every stage but the last returns the columns of documents; the last one returns the packed pieces. No stage can be
expressed in SQL as a whole (a fitted classifier, SimHash groups, random mixing), so ORACLE_SQL is None and
``tests/llm/test_pipeline.py`` holds each stage against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexepoch.llm import exactdedup, mixing, packing, simhash, toxicity
from lexepoch.llm.common import materialize, sieve, sifted


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score of 0.3 or more) go; it learns from labelled rows not held out.

    A null or empty text has the score of the bias; repeated rows are judged each; extra columns are carried along.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(toxicity.labelled_rows(docs, labels))
    scored = toxicity.with_score(docs, model, "_lx_score")
    return scored.where("_lx_score < 0.3").drop("_lx_score")


def exact_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts the one with the least doc_id stays.

    Null counts as empty; repeated rows of the id that stays all stay; a null id stays only where no other id has the text.
    """
    return exactdedup.drop_exact_duplicates(docs)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard similarity of at least 0.8) one document stays.

    Rows that share an id are one document, so they stay or go together. Rows without an id or without words stay.
    Rows whose id is surely not dropped are kept where they lie; only the others are shuffled, at every size.
    """
    groups = simhash.near_duplicate_groups(docs)
    dropped = materialize(groups.where("doc_id <> group_id").select(F.col("doc_id").alias("_lx_id")))
    told = sifted(docs, docs["doc_id"].cast("long"), sieve(dropped, "_lx_id"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    left = told.where("_lx_maybe").join(dropped.hint("merge"), F.col("doc_id").cast("long") == F.col("_lx_id"), "left_anti")
    return told.where("NOT _lx_maybe").select(*columns).unionByName(left.select(*columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Sources without a name are one source, the last; a text without words takes part in the count of documents only.
    """
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: one row per piece of a document, with its ids and its place.

    A null or empty text is the end token alone; repeated rows are packed each.
    """
    return packing.pack_documents(docs, with_ids=True)


STAGES = [
    ("toxicity", toxic_out),
    ("exact dedup", exact_copies_out),
    ("simhash near-dedup", near_copies_out),
    ("mixing to target weights", mixed),
    ("best-fit packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
