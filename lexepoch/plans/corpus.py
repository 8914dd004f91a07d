"""The corpus job end to end (C29): parse, identify, segment, extract evidence and edges, verify."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import canonical, evidence, segment, verify
from ..sources import tables as X
from ..sources.scratch import new_path
from ..sources.tables import with_views


def process(items: DataFrame, run_date: str | None = None, segmented: bool = True) -> dict[str, DataFrame]:
    """items (document_id, title, text, source_id, source_authority and, if known, published) -> tables documents, provisions,
    relationships, evidence, events, verdicts, errors. Items without a title or a text are errors and stop no other item.

    Every item that is taken is an event: its document was published, on the run's date where the item has none.
    Without ``segmented`` texts are not cut: there are no provisions and evidence, all other tables are the same.
    """
    items = items if "published" in items.columns else items.withColumn("published", F.lit(None).cast("date"))
    bad = F.coalesce(F.trim("title"), F.lit("")) == ""
    empty = F.coalesce(F.trim("text"), F.lit("")) == ""
    errors = items.where(bad | empty).select("document_id", F.when(bad, "MISSING_TITLE").otherwise("MISSING_TEXT").alias("reason"))
    parsed = items.where(~bad & ~empty).select(
        "document_id", "text", "source_id", "source_authority", "published", F.inline(F.array(T.metadata(F.col("title"), F.col("text")))))  # rows that a generator makes: fields used twice are worked out once
    spark = items.sparkSession
    path = new_path(spark, "parsed")
    parsed.withColumn("canonical_id", T.canonical_id(F.col("document_type"), F.col("document_number"), F.col("issued_date"), F.concat_ws("|", "title", "source_id"))).write.parquet(path)
    named = spark.read.parquet(path)  # parsed once: all tables below come from it
    docs, srcs = canonical.merge(named, named.select("document_id", "source_id", "source_authority"))
    asserts = named.join(srcs.select("source_id", F.col("document_id").alias("kept")), "source_id").select(
        F.col("kept").alias("document_id"), "source_id", "source_authority", "document_number", "issued_date", "effective_from", F.lit(None).cast("date").alias("effective_to"))
    day = F.coalesce("published", F.lit(run_date).cast("date") if run_date else T.local_today(F.current_timestamp()))
    events = named.join(srcs.select("source_id", F.col("document_id").alias("kept")), "source_id").select(
        F.col("kept").alias("document_id"), F.lit("published").alias("event_type"), day.alias("event_date"), "effective_from",
        F.concat(F.lit("Document published: "), "title").alias("description"), F.col("source_id").alias("snapshot_id"))
    out = {"documents": docs, "events": events, "relationships": segment.resolve(segment.relationships(docs), docs), "verdicts": verify.verdicts(asserts), "errors": errors}
    if segmented:
        cut = new_path(spark, "provisions")
        segment.provisions(docs).withColumn("provision_id", F.xxhash64("document_id", "sort_key")).write.parquet(cut)
        provs = spark.read.parquet(cut)  # segmented once: evidence reads them, too
        out |= {"provisions": provs, "evidence": evidence.from_metadata(docs, provs)}
    return out


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """Every document from one or two sources, with up to three articles of two clauses each, a few without a text; the
    second source states another date now and then."""
    from .text_queries import _texts
    d = _texts(spark, sf)
    i = F.col("document_id")
    copies = d.withColumn("copy", F.explode(F.when(i % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    article = lambda n: F.concat(F.lit("\nĐiều "), n.cast("string"), F.lit(". Nội dung\n1. Khoản một\n2. Khoản hai"))
    articles = F.when(i % 4 > 0, F.array_join(F.transform(F.sequence(F.lit(1), (i % 4).cast("int")), article), "")).otherwise("")
    stated = F.when((F.col("copy") == 1) & (i % 12 == 0), F.regexp_replace("text", "năm ([0-9]{4})\nVăn", "năm 1980\nVăn")).otherwise(F.col("text"))
    text = F.when(i % 50 == 49, F.lit("")).otherwise(F.concat(stated, articles))
    return copies.select((i * 2 + F.col("copy")).alias("document_id"), "title", text.alias("text"), (i * 2 + F.col("copy")).alias("source_id"), F.lit("tier_a").alias("source_authority"))


def c29_events(spark: SparkSession, sf: str) -> DataFrame:
    """Every item's event; items of even documents carry a date."""
    items = _items(spark, sf)
    dated = F.when(F.col("document_id") % 4 < 2, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("document_id") % 100).cast("int")))
    return process(items.withColumn("published", dated), "2024-06-30", segmented=False)["events"].drop("description")


def c29_corpus(spark: SparkSession, sf: str) -> DataFrame:
    out = process(_items(spark, sf))
    n = out["provisions"].groupBy("document_id").agg(F.count(F.lit(1)).alias("n_provisions"))
    return (out["documents"].select("document_id", "canonical_id").join(n, "document_id", "left")
            .join(out["verdicts"].select("document_id", "n_sources", "status"), "document_id", "left"))


_CODE = "CASE document_id % 6 WHEN 0 THEN 'LUAT' WHEN 1 THEN 'ND' WHEN 2 THEN 'TT' WHEN 3 THEN 'QD' WHEN 4 THEN 'CV' ELSE 'TB' END"
_C29 = with_views(f"""SELECT document_id * 2 AS document_id, 'VN:' || {_CODE} || ':' || year(issued_date) || ':' || document_id || '-' || year(issued_date) || '-ND-CP' AS canonical_id,
  CASE WHEN document_id % 4 = 0 THEN 1 ELSE 3 * (document_id % 4) END AS n_provisions, CASE WHEN document_id % 3 = 0 THEN 2 ELSE 1 END AS n_sources, CASE WHEN document_id % 12 = 0 AND effective_from IS NOT NULL THEN 'conflicting'
    WHEN effective_from IS NULL THEN 'single_source_verified' WHEN document_id % 3 = 0 THEN 'cross_verified' ELSE 'single_source_verified' END AS status
  FROM x_docs WHERE document_id % 50 <> 49""")

_C29_EVENTS = with_views("""SELECT document_id * 2 AS document_id, 'published' AS event_type, CASE WHEN (document_id * 2 + copy) % 4 < 2 THEN CAST(DATE '2024-01-01' + ((document_id * 2 + copy) % 100)::INT AS DATE)
    ELSE DATE '2024-06-30' END AS event_date, effective_from, document_id * 2 + copy AS snapshot_id
  FROM x_docs JOIN (SELECT 0 AS copy UNION ALL SELECT 1) c ON copy = 0 OR document_id % 3 = 0 WHERE document_id % 50 <> 49""")

QUERIES = {"c29_corpus": c29_corpus, "c29_events": c29_events}
ORACLE = {"c29_corpus": _C29, "c29_events": _C29_EVENTS}
