"""Intake runs: late items out, sources matched or made, snapshots logged, marks moved, all of it one ledger batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.ledger import Ledger
from . import snapshots

ITEM = "source_name string, url string, item_id long, published date, page_hash string"
SCHEMAS = {
    "items": "source_id string, source_name string, url string, item_id long, published date",
    "sources": "source_id string, source_name string, url string",
    "snapshots": "source_id string, version int, snapshot_id long, page_hash string, text_hash string, metadata_hash string",
    "marks": "source_name string, last_date date, last_item long",
}


def open_ledger(spark: SparkSession, path: str) -> Ledger:
    return Ledger(spark, path, SCHEMAS)


def moved_marks(old: DataFrame, items: DataFrame) -> DataFrame:
    """Marks after items: the latest date of each source, and the item that has it; undated items move nothing back or on."""
    new = snapshots.checkpoints(items.where("published IS NOT NULL")).select("source_name", "last_date", "last_item")
    both = old.unionByName(new).groupBy("source_name").agg(F.max(F.struct("last_date", "last_item")).alias("m"))
    return both.select("source_name", "m.last_date", "m.last_item")


def build(ledger: Ledger, items: DataFrame, force: bool = False) -> dict[str, DataFrame]:
    """What one batch of items (ITEM columns) adds.

    An item is late if it is strictly older than its source's mark of the batches before. A (source_name, url) that no
    batch has seen becomes one source, however often the batch holds it; the page of an item is a snapshot if it differs
    from the source's last one.
    """
    marks = ledger.state("marks")
    admitted = ledger.staged("admitted", snapshots.match_sources(snapshots.admit(items, marks, force), ledger.table("sources")))
    pages = admitted.select("source_id", F.lit(0).alias("version"), F.col("item_id").alias("snapshot_id"), "page_hash",
                            F.lit(None).cast("string").alias("text_hash"), F.lit(None).cast("string").alias("metadata_hash"))
    seen = ledger.table("snapshots").join(admitted.select("source_id").distinct(), "source_id", "left_semi")
    return {"items": admitted, "sources": admitted.where("is_new").select("source_id", "source_name", "url").dropDuplicates(["source_id"]),
            "snapshots": snapshots.apply(seen, pages)[0], "marks": moved_marks(marks, admitted)}


def drift_lanes(batch: DataFrame, group: str) -> dict[str, DataFrame]:
    """T7 as a ledger batch: tables written and diverted, of groups in good and in bad order."""
    from ..streaming.streams import tagged
    rows = tagged(batch, group)
    return {"written": rows.where("circuit = 'HEALTHY'").drop("circuit"), "diverted": rows.where("circuit <> 'HEALTHY'").drop("circuit")}
