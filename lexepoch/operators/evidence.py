"""Evidence rows and their quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

METADATA_FIELDS = ("title", "document_nature", "document_number", "issuer_name", "issued_date", "effective_from")
RECORD_FIELDS = ("document_number", "title", "issuer", "issued_date", "effective_date", "expiration_date", "status_metadata",
                 "relationships", "history", "attachments", "item_id")


def _rows(df: DataFrame, keys: list[str], fields: tuple[str, ...], kind: str) -> DataFrame:
    have = [f for f in fields if f in df.columns]
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("asserted_value")) for f in have])
    return (df.select(*keys, F.explode(pairs).alias("e")).select(*keys, "e.*").where("asserted_value IS NOT NULL AND asserted_value <> ''")
            .withColumn("evidence_type", F.lit(kind)))


def from_metadata(docs: DataFrame, provs: DataFrame, snapshot: str = "document_id") -> DataFrame:
    """One row per known metadata field and one per provision, whose text is cut to 500 characters."""
    null = F.lit(None).cast("string")
    meta = _rows(docs.withColumn("snapshot_id", F.col(snapshot)), ["document_id", "snapshot_id"], METADATA_FIELDS, "metadata").select(
        "document_id", "snapshot_id", F.lit(None).cast("long").alias("provision_id"), "field_name", "asserted_value", "evidence_type", null.alias("locator"))
    own = provs.select("document_id", F.col("document_id").alias("snapshot_id"), "provision_id", F.lit("content").alias("field_name"),
                       F.substring("content", 1, 500).alias("asserted_value"), F.lit("provision_text").alias("evidence_type"),
                       F.concat_ws(" ", "article", "clause").alias("locator"))
    return meta.unionByName(own)


def from_records(records: DataFrame, fields: tuple[str, ...] = RECORD_FIELDS) -> DataFrame:
    """Rows of a second source's records (document_id, snapshot_id, fields of the map that are present)."""
    return _rows(records, ["document_id", "snapshot_id"], fields, "second_source")


def for_provisions(provs: DataFrame, evidence: DataFrame) -> DataFrame:
    """(provision_id, n_evidence, fields): evidence of the document as a whole and of the provision itself."""
    whole = (evidence.where("provision_id IS NULL").groupBy("document_id").agg(F.count(F.lit(1)).alias("n_doc"), F.collect_set("field_name").alias("f_doc")))
    own = (evidence.where("provision_id IS NOT NULL").groupBy("provision_id").agg(F.count(F.lit(1)).alias("n_own"), F.collect_set("field_name").alias("f_own")))
    none = F.array().cast("array<string>")
    return provs.select("provision_id", "document_id").join(whole, "document_id", "left").join(own, "provision_id", "left").select(
        "provision_id", (F.coalesce("n_doc", F.lit(0)) + F.coalesce("n_own", F.lit(0))).alias("n_evidence"),
        F.array_join(F.array_sort(F.array_union(F.coalesce("f_doc", none), F.coalesce("f_own", none))), ",").alias("fields"))


def quarantine(evidence: DataFrame, conflicts: DataFrame, poison: list[str]) -> tuple[DataFrame, DataFrame]:
    """(evidence, conflicts): evidence with a value of the short poison list is quarantined, conflicts on such a value resolved."""
    bad = F.coalesce(F.col("asserted_value").isin(*poison), F.lit(False))
    marked = evidence.withColumn("is_quarantined", F.coalesce("is_quarantined", F.lit(False)) | bad).withColumn(
        "environment", F.when(bad, "test").otherwise(F.col("environment")))
    hit = F.coalesce(F.col("value_a").isin(*poison) | F.col("value_b").isin(*poison), F.lit(False))
    closed = conflicts.withColumn("resolved", hit).withColumn("conflict_type", F.when(hit, "SYNTHETIC_TEST_CONFLICT").otherwise("VALUE_MISMATCH"))
    return marked, closed
