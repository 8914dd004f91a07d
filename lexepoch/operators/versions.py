"""Versions of provisions: the one in force at a date, chains, and what changed between two dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .status import within

KEY = ("document_id", "article", "clause")


def as_of(provs: DataFrame, dates: list[str]) -> DataFrame:
    """The version of each (document, article, clause) in force at each date; where two hold, the later start wins."""
    # Each provision is shuffled and sorted once, not once a date: dates are folds of a key's rows, and rows only after them.
    days = [F.lit(d).cast("date") for d in dict.fromkeys(dates)]
    dealt = provs.select(*KEY, "provision_id", "content", "valid_from", "valid_to").repartition(*KEY)
    row, start = F.struct("provision_id", "content", "valid_from", "valid_to"), F.struct("valid_from", "provision_id")
    best = dealt.groupBy(*KEY).agg(*[F.max_by(row, F.when(within(d, F.col("valid_from"), F.col("valid_to")), start)).alias(f"v{i}") for i, d in enumerate(days)])
    held = best.select(*KEY, F.explode_outer(F.array(*[F.struct(d.alias("as_of"), F.col(f"v{i}").alias("v")) for i, d in enumerate(days)])).alias("e")).where("e.v IS NOT NULL")
    return held.select(*KEY, "e.as_of", "e.v.provision_id", "e.v.content", "e.v.valid_from", "e.v.valid_to")


def chain(provs: DataFrame) -> DataFrame:
    """Each version with the version before it and an end closed by the next start where it had none."""
    w = Window.partitionBy(*KEY).orderBy(F.col("valid_from").asc_nulls_first(), "provision_id")
    return provs.select("provision_id", *KEY, "valid_from", F.coalesce("valid_to", F.lead("valid_from").over(w)).alias("closed_to"),
                        F.lag("provision_id").over(w).alias("previous_id"))


def compare(provs: DataFrame, before: str, after: str) -> DataFrame:
    """(document_id, article, clause, change, new_article): UNCHANGED, MODIFIED, ADDED, REMOVED, RENUMBERED or UNKNOWN.

    Removed and added provisions of one document with the same content are one renumbered provision. Where a version's
    content is not known (null), whether it has changed is not either.
    """
    digest = F.sha2("content", 256)
    side = lambda d, p: as_of(provs, [d]).select(*[F.col(k).alias(f"{p}_{k}") for k in KEY], digest.alias(f"{p}_hash"), F.lit(True).alias(f"in_{p}"))
    on = [F.col(f"old_{k}").eqNullSafe(F.col(f"new_{k}")) for k in KEY]
    both = side(before, "old").join(side(after, "new"), on, "full").select(
        *[F.coalesce(f"old_{k}", f"new_{k}").alias(k) for k in KEY], "old_hash", "new_hash", "in_old", "in_new")
    known = both.withColumn("change", F.when(F.col("in_old").isNull(), "ADDED").when(F.col("in_new").isNull(), "REMOVED")
                            .when(F.col("old_hash").isNull() | F.col("new_hash").isNull(), "UNKNOWN").when(F.col("old_hash") == F.col("new_hash"), "UNCHANGED").otherwise("MODIFIED"))
    order = Window.partitionBy("document_id", "h").orderBy("article", "clause")
    gone = (known.where("change = 'REMOVED'").withColumn("h", F.col("old_hash")).withColumn("n", F.row_number().over(order))
            .select("document_id", "article", "clause", "h", "n"))
    came = (known.where("change = 'ADDED'").withColumn("h", F.col("new_hash")).withColumn("n", F.row_number().over(order))
            .select("document_id", F.col("article").alias("new_article"), F.col("clause").alias("new_clause"), "h", "n"))
    moved = gone.join(came, ["document_id", "h", "n"])
    renumbered = moved.select("document_id", "article", "clause", F.lit("RENUMBERED").alias("change"), "new_article")
    same = lambda a, b: F.coalesce(a, F.lit("")) == F.coalesce(b, F.lit(""))
    m = moved.select(F.col("document_id").alias("m_doc"), F.col("article").alias("m_article"), F.col("clause").alias("m_clause"), "new_article", "new_clause")
    rest = known.join(m, (F.col("document_id") == F.col("m_doc")) & (
        ((F.col("change") == "REMOVED") & same(F.col("article"), F.col("m_article")) & same(F.col("clause"), F.col("m_clause")))
        | ((F.col("change") == "ADDED") & same(F.col("article"), F.col("new_article")) & same(F.col("clause"), F.col("new_clause")))), "left_anti")
    return rest.select("document_id", "article", "clause", "change", F.lit(None).cast("string").alias("new_article")).unionByName(renumbered)
