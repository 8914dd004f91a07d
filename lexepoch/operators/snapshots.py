"""Append-only snapshots: pointer, change detection, intake, integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import text as T

HASHES = ("page_hash", "text_hash", "metadata_hash")


def current(srcs: DataFrame, snaps: DataFrame) -> DataFrame:
    """The current snapshot of each source: the pointer's, else one marked current, else the newest."""
    j = snaps.join(srcs.select("source_id", "current_snapshot_id"), "source_id")
    w = Window.partitionBy("source_id").orderBy(
        F.coalesce(F.col("snapshot_id") == F.col("current_snapshot_id"), F.lit(False)).desc(), F.coalesce(F.col("is_current"), F.lit(False)).desc(),
        F.col("fetched_at").desc(), F.col("snapshot_id").desc())
    return j.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "current_snapshot_id")


def hashed(versions: DataFrame) -> DataFrame:
    """Versions (source_id, version, snapshot_id, text and, if there is one, metadata, a map) with the hashes of page, normalised text and metadata."""
    metadata = T.object_hash(F.col("metadata")) if "metadata" in versions.columns else F.lit(None).cast("string")
    return versions.select("source_id", "version", "snapshot_id", F.sha2("text", 256).alias("page_hash"),
                           F.sha2(T.normalized_text(F.col("text")), 256).alias("text_hash"), metadata.alias("metadata_hash"))


def changes(log: DataFrame) -> DataFrame:
    """Each snapshot against the one before of its source: CREATED, CHANGED or UNCHANGED; a null hash keeps the old one."""
    order = Window.partitionBy("source_id").orderBy("version")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    changed = reduce(lambda a, b: a | b, [F.coalesce(F.col(h) != F.last(h, True).over(earlier), F.col(h).isNotNull() & F.last(h, True).over(earlier).isNull()) for h in HASHES])
    first = F.row_number().over(order) == 1
    return log.withColumn("change", F.when(first, "CREATED").when(changed, "CHANGED").otherwise("UNCHANGED"))


def apply(log: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to append, audit): incoming snapshots that are new or differ from the one before of their source.

    Several of one source are taken by version and snapshot_id, each against the one before, and numbered on from the
    log's last version. Applying the same input again appends nothing where a batch has one row per source. Unchanged
    snapshots are only touched (audit event CHECKED); a null hash says nothing and keeps the old one.
    """
    last = log.groupBy("source_id").agg(F.max_by(F.struct(*HASHES), "version").alias("old"), F.max("version").alias("old_version"))
    j = incoming.join(last, "source_id", "left")
    order = Window.partitionBy("source_id").orderBy("version", "snapshot_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    new = F.col("old_version").isNull() & (F.row_number().over(order) == 1)
    differ = reduce(lambda a, b: a | b, [F.col(h).isNotNull() & ~F.col(h).eqNullSafe(F.coalesce(F.last(h, True).over(before), F.col(f"old.{h}"))) for h in HASHES])
    event = F.when(new, "SOURCE_CREATED").when(differ, "SOURCE_CHANGED").otherwise("CHECKED")
    tagged = j.withColumn("event", event)
    append = tagged.where("event <> 'CHECKED'").withColumn("version", F.coalesce(F.col("old_version"), F.lit(0)) + F.row_number().over(order))
    return append.select(*incoming.columns), tagged.select("source_id", "snapshot_id", "event")


def integrity(objects: DataFrame, recorded: DataFrame) -> DataFrame:
    """(source_id, state): VERIFIED, MISMATCH or MISSING, by hashing the stored bytes against the recorded hash."""
    own = objects.select("source_id", F.sha2("text", 256).alias("actual"))
    j = recorded.select("source_id", "page_hash").join(own, "source_id", "left")
    return j.select("source_id", F.when(F.col("actual").isNull(), "MISSING").when(F.col("actual") == F.col("page_hash"), "VERIFIED").otherwise("MISMATCH").alias("state"))


def compare_versions(before: DataFrame, after: DataFrame, buckets: int = 4096) -> DataFrame:
    """One row: rows of both versions and rows each has alone (as multisets).

    Rows are told apart by sums of two 64-bit hashes per bucket, which do not depend on order: rows are shuffled only
    from buckets whose sums or counts differ. Two versions whose 128 bits agree in every bucket count as equal.
    """
    cols = before.columns
    digest = lambda salt: F.xxhash64(F.lit(salt), *cols, *[F.col(c).isNull() for c in cols])
    tagged = before.select(*cols, F.lit(1).alias("_s")).unionByName(after.select(*cols, F.lit(-1).alias("_s"))).select(
        "*", digest(1).alias("_h"), digest(2).alias("_g"))
    tagged = tagged.withColumn("_b", F.pmod("_h", F.lit(buckets)).cast("int"))
    side = lambda c, n: F.sum(F.when(F.col("_s") == n, c.cast("decimal(20,0)")).otherwise(F.lit(0).cast("decimal(20,0)")))
    sums = tagged.groupBy("_b").agg(F.count_if(F.col("_s") == 1).alias("b"), F.count_if(F.col("_s") == -1).alias("a"), *[
        side(F.col(c), n).alias(f"{c}{i}") for c in ("_h", "_g") for i, n in enumerate((1, -1))])
    same = (F.col("b") == F.col("a")) & (F.col("_h0") == F.col("_h1")) & (F.col("_g0") == F.col("_g1"))
    totals = sums.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("a"), F.lit(0)).alias("rows_after"))
    # One row a bucket at most: small whatever the tables hold.
    rest = tagged.join(F.broadcast(sums.where(~same).select("_b")), "_b", "left_semi")
    per = rest.groupBy(*cols).agg(F.sum("_s").alias("d"))
    alone = per.agg(F.coalesce(F.sum(F.greatest(F.col("d"), F.lit(0))), F.lit(0)).alias("only_before"), F.coalesce(F.sum(F.greatest(-F.col("d"), F.lit(0))), F.lit(0)).alias("only_after"))
    one = totals.unionByName(alone, allowMissingColumns=True)
    return one.agg(*[F.max(c).alias(c) for c in one.columns]).withColumn("identical", (F.col("only_before") == 0) & (F.col("only_after") == 0))


def match_sources(items: DataFrame, srcs: DataFrame) -> DataFrame:
    """Items with the source they belong to by (source_name, url); unknown ones get the id of a new stub."""
    known = srcs.groupBy("source_name", "url").agg(F.min("source_id").alias("known_id"))
    j = items.join(known, ["source_name", "url"], "left")
    return j.withColumn("is_new", F.col("known_id").isNull()).withColumn(
        "source_id", F.coalesce(F.col("known_id").cast("string"), F.sha2(F.concat_ws("|", "source_name", "url"), 256))).drop("known_id")


def admit(items: DataFrame, checkpoints: DataFrame, force: bool = False) -> DataFrame:
    """Items not strictly older than their source's mark; undated items always pass, with force all do."""
    if force:
        return items
    j = items.join(checkpoints.select("source_name", "last_date"), "source_name", "left")
    return j.where(F.col("published").isNull() | F.col("last_date").isNull() | (F.col("published") >= F.col("last_date"))).drop("last_date")


def checkpoints(items: DataFrame) -> DataFrame:
    """High-water mark per source: latest date and the item that has it."""
    return items.groupBy("source_name").agg(F.max("published").alias("last_date"),
                                            F.max_by("item_id", F.struct("published", "item_id")).alias("last_item"))


def pointers(srcs: DataFrame, log: DataFrame) -> DataFrame:
    """(source_id, current_snapshot_id): the pointer view of an append-only log (source_id, version, snapshot_id), the latest version of each source."""
    newest = log.groupBy("source_id").agg(F.max_by("snapshot_id", F.struct("version", "snapshot_id")).alias("current_snapshot_id"))
    return srcs.select("source_id").distinct().join(newest, "source_id", "left")


def repoint(srcs: DataFrame, snaps: DataFrame, evidence: DataFrame) -> DataFrame:
    """srcs (source_id, current_snapshot_id) away from snapshots with quarantined evidence: to the newest snapshot without, null if there is none."""
    bad = evidence.where(F.coalesce("is_quarantined", F.lit(False))).select("snapshot_id").distinct()
    spoilt = srcs.join(bad, srcs.current_snapshot_id == bad.snapshot_id, "left_semi").select("source_id")
    clean = (snaps.join(spoilt, "source_id", "left_semi").join(bad, "snapshot_id", "left_anti").groupBy("source_id")
             .agg(F.max_by("snapshot_id", F.struct("fetched_at", "snapshot_id")).alias("_clean")))
    tagged = srcs.join(spoilt.withColumn("_spoilt", F.lit(True)), "source_id", "left").join(clean, "source_id", "left")
    return tagged.withColumn("current_snapshot_id", F.when(F.col("_spoilt"), F.col("_clean")).otherwise(F.col("current_snapshot_id"))).drop("_spoilt", "_clean")
