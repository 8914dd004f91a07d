"""Identity of documents: matching candidates, merging duplicates."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, functions as F


def match(cands: DataFrame, docs: DataFrame, least: float = 0.7, earlier: bool = False) -> DataFrame:
    """Best match of each candidate: number 0.5, issued date 0.3, text hash 0.2, title 0.2, at most 1; a match needs 0.7.
    A candidate without such a match is matched at 0.95 by its text hash alone. Ties go to the smallest document_id.

    Both sides have document_number (normalised), issued_date, text_hash, title_fp; the candidate has candidate_id, and
    with ``earlier`` is matched with documents of smaller ids only. Each document is one row for every set of signals that
    makes a match, and rows of equal values are folded to the one with the least id: of the documents that share a
    candidate's best set that one counts, so one grouping and one join do, and no group emits its pairs.
    """
    signal = ("document_number", "issued_date", "text_hash", "title_fp")
    points = dict(zip(signal, (50, 30, 20, 20)))
    sets = [s for n in range(1, len(signal) + 1) for s in combinations(signal, n) if sum(points[c] for c in s) >= round(100 * least)]
    sets = list(dict.fromkeys([*sets, ("text_hash",)]))

    def keyed(df: DataFrame, own: str) -> DataFrame:
        """One row a set whose signals are all there: the set, and a digest of their values."""
        part = lambda c: F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string"))
        keys = F.array_compact(F.array(*[F.when(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in s]), F.md5(F.concat(F.lit(f"{i}|"), *[part(c) for c in s]))) for i, s in enumerate(sets)]))
        return df.select(F.col(own).alias(own), *signal, F.explode(keys).alias("key"))

    folded = keyed(docs, "document_id").groupBy("key").agg(F.min(F.struct("document_id", *[F.col(c).alias(f"d_{c}") for c in signal])).alias("x")).select("key", "x.*")
    both = keyed(cands, "candidate_id").join(folded, "key")
    both = both.where("document_id < candidate_id") if earlier else both
    hit = lambda c: F.coalesce(F.col(c) == F.col(f"d_{c}"), F.lit(False))
    score = F.least(F.lit(1.0), F.round(sum((F.when(hit(c), points[c] / 100).otherwise(0.0) for c in signal), F.lit(0.0)), 6))
    signals = F.array_compact(F.array(*[F.when(hit(c), F.lit(c)) for c in signal]))
    scored = both.select("candidate_id", "document_id", score.alias("s"), signals.alias("signals")).withColumn("by", F.when(F.col("s") >= least, 0).otherwise(1)).where((F.col("by") == 0) | F.array_contains("signals", "text_hash"))
    best = F.min(F.struct("by", F.when(F.col("by") == 0, -F.col("s")).otherwise(-0.95).alias("less"), "document_id", "signals")).alias("b")
    return scored.groupBy("candidate_id").agg(best).select("candidate_id", "b.document_id", (-F.col("b.less")).alias("score"), "b.signals")


def merge(docs: DataFrame, srcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, sources): one document per canonical_id (the smallest id), sources repointed to it."""
    keeper = docs.groupBy("canonical_id").agg(F.min("document_id").alias("keep_id"))
    tagged = docs.join(keeper, "canonical_id")
    kept = tagged.where("document_id = keep_id").drop("keep_id")
    moved = srcs.join(tagged.select("document_id", "keep_id"), "document_id").withColumn("document_id", F.col("keep_id")).drop("keep_id")
    return kept, moved
