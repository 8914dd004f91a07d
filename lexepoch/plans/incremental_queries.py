"""Queries on runs that go on from what earlier ones have committed."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import intake, snapshots, verify
from ..operators.evidence import quarantine
from ..sources import tables as X
from ..sources.ledger import Ledger
from ..sources.scratch import new_path
from ..sources.tables import with_views
from ..streaming import streams
from .source_queries import _GAPS, _T7
from .temporal_queries import _ADM, _AG, _CONF, _PER, _VERD


# -- intake -----------------------------------------------------------------------------------------------------------
def c7_intake_run(spark: SparkSession, sf: str) -> DataFrame:
    """Events as feed items in four landings, some delivered a landing late. Two of the runs are lost between data and ledger row and are run again.

    The result is the snapshot log of every source, which late items do not reach.
    """
    path = new_path(spark, "c7")
    landing = F.floor((F.dayofmonth("event_date") - 1) / 8) + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0)
    items = X.x_events(spark, sf).select(
        landing.cast("int").alias("landing"), F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("source_name"),
        F.concat(F.lit("https://example.org/"), (F.col("user_id") % 50).cast("string")).alias("url"), F.col("event_id").alias("item_id"),
        F.col("event_date").alias("published"), F.sha2(F.floor(F.col("event_id") / 40).cast("string"), 256).alias("page_hash"))
    ledger, lost = intake.open_ledger(spark, f"{path}-tables"), []

    def fail(number: int) -> None:
        if number in (0, 2) and number not in lost:
            lost.append(number)
            raise RuntimeError("lost between data and ledger row")

    for n in range(5):
        items.where(F.col("landing") == n).drop("landing").write.mode("append").parquet(f"{path}-in")
        for _ in range(2):
            try:
                streams.intake_run(streams.intake(spark, f"{path}-in", intake.ITEM), ledger, f"{path}-checkpoint", before_commit=fail)
                break
            except StreamingQueryException:
                pass
    sources = ledger.table("sources")
    return ledger.table("snapshots").join(sources, "source_id").select("source_name", "url", "version", "snapshot_id", "page_hash")


_LANDED = ("landed", """SELECT (day(event_date) - 1) // 8 + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS landing, 'u' || (user_id % 5) AS source_name,
  'https://example.org/' || (user_id % 50) AS url, event_id AS item_id, event_date AS published, sha256(CAST(event_id // 40 AS VARCHAR)) AS page_hash FROM x_events""")
_ON_TIME = ("on_time", """SELECT * FROM (SELECT *, max(published) OVER (PARTITION BY source_name ORDER BY landing RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM landed)
  WHERE mark IS NULL OR published >= mark""")
_C7_RUN = with_views("""SELECT source_name, url, CAST(row_number() OVER (PARTITION BY source_name, url ORDER BY landing, item_id) AS INTEGER) AS version, item_id AS snapshot_id, page_hash FROM (
  SELECT *, lag(page_hash) OVER (PARTITION BY source_name, url ORDER BY landing, item_id) AS before FROM on_time) WHERE before IS NULL OR before <> page_hash""", _LANDED, _ON_TIME)


def t7_drift_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Records of the documents by source, some sources with gaps, in one micro-batch: both lanes in one ledger batch."""
    d, i = X.load(spark, sf, "documents"), F.col("doc_id")
    source = F.when(F.col("lang") == "en", F.col("source"))
    gap = F.coalesce(source, F.lit("none")).isin(*_GAPS) & (i % 4 == 0)
    path, schema = new_path(spark, "t7s"), "doc_id long, source string, document_number string, title string, effective_date string, issuer string"
    d.select("doc_id", source.alias("source"), i.cast("string").alias("document_number"), F.lit("t").alias("title"),
             F.when(~gap, F.lit("2024-01-01")).alias("effective_date"), F.lit("x").alias("issuer")).write.parquet(f"{path}-in")
    ledger = Ledger(spark, f"{path}-tables", {"written": schema, "diverted": schema})
    streams.drift_stream(streams.intake(spark, f"{path}-in", schema), "source", ledger, f"{path}-checkpoint")
    lane = lambda name: ledger.table(name).select("doc_id", "source", F.lit(name).alias("lane"))
    return lane("written").unionByName(lane("diverted"))


# -- verification on current snapshots --------------------------------------------------------------------------------
def _own(column: str = "source_id"):
    """A source of one document: the base tables share sources between documents."""
    return F.col("document_id") * 100_000 + F.col(column)


def _snapshots(spark: SparkSession, sf: str, second: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sources, their snapshots and the evidence of both; those where ``second`` holds have two, the first with other dates of entry into force."""
    s = X.x_srcs(spark, sf).withColumn("supp", F.col("source_id")).withColumn("two", F.expr(second)).withColumn("source_id", _own())
    versions = F.explode(F.when(F.col("two"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("v")
    srcs = s.select("document_id", "source_id", "source_authority", F.when(F.col("two") & (F.col("supp") % 3 == 0), F.col("source_id") * 10 + 2).alias("current_snapshot_id"))
    snaps = s.select("source_id", "supp", versions).select(
        "source_id", (F.col("source_id") * 10 + F.col("v")).alias("snapshot_id"), ((F.col("supp") % 3 == 1) & (F.col("v") == 1)).alias("is_current"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("v")).alias("fetched_at"))
    e = X.x_evid(spark, sf).withColumn("two", F.expr(second.replace("supp", "source_id"))).select("*", versions)
    moved = (F.col("v") == 1) & (F.col("field_name") == "effective_from") & (F.col("source_id") % 4 == 0)
    evidence = e.withColumn("asserted_value", F.when(moved, F.date_add(F.col("asserted_value").cast("date"), 7).cast("string")).otherwise(F.col("asserted_value"))).withColumn(
        "snapshot_id", _own() * 10 + F.col("v")).drop("two", "v", "source_id")
    return srcs, snaps, evidence


def c13_current_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Two snapshots a source: the pointer's speaks, else the one marked current, else the newest."""
    srcs, snaps, evidence = _snapshots(spark, sf, "TRUE")
    return verify.corpus(X.x_docs(spark, sf), srcs, evidence, snaps)


def c13_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus verified on first snapshots; then a fifth of the sources get second ones, and what they touch is verified again.

    n_recorded counts the conflicts recorded by both runs, each once.
    """
    docs = X.x_docs(spark, sf)
    ledger = Ledger(spark, new_path(spark, "c13"), verify.LEDGER)
    verify.reverify(ledger, 0, docs, *_snapshots(spark, sf, "FALSE"))
    srcs, snaps, evidence = _snapshots(spark, sf, "supp % 5 = 0")
    verify.reverify(ledger, 1, docs, srcs, snaps, evidence, changed=snaps.where("snapshot_id % 10 = 2"))
    recorded = ledger.table("conflicts").groupBy("document_id").agg(F.count(F.lit(1)).alias("n_recorded"))
    return verify.verdicts_now(ledger).join(recorded, "document_id", "left").withColumn("n_recorded", F.coalesce("n_recorded", F.lit(0).cast("long")))


_POISON = ["1997-03-01", "1998-07-15", "1999-02-08"]


def c20_repointed(spark: SparkSession, sf: str) -> DataFrame:
    """Sources point to their second snapshot; evidence of poisoned values is quarantined, and what spoke from such snapshots points to a clean one."""
    srcs, snaps, evidence = _snapshots(spark, sf, "TRUE")
    srcs = srcs.withColumn("current_snapshot_id", F.col("source_id") * 10 + 2)
    marked, _ = quarantine(evidence, verify.conflicts(X.x_asserts(spark, sf)), _POISON)
    return snapshots.repoint(srcs, snaps, marked).select("source_id", "current_snapshot_id")


_C20_REPOINTED = with_views("""SELECT s.document_id * 100000 + s.source_id AS source_id, (s.document_id * 100000 + s.source_id) * 10 + CASE WHEN b2.v IS NULL THEN 2 WHEN b1.v IS NULL THEN 1 END AS current_snapshot_id
  FROM x_srcs s LEFT JOIN bad b1 ON b1.document_id = s.document_id AND b1.source_id = s.source_id AND b1.v = 1 LEFT JOIN bad b2 ON b2.document_id = s.document_id AND b2.source_id = s.source_id AND b2.v = 2""",
                            ("bad", f"""SELECT DISTINCT document_id, source_id, v FROM (SELECT *, CASE WHEN v = 1 AND field_name = 'effective_from' AND source_id % 4 = 0
  THEN CAST(CAST(CAST(asserted_value AS DATE) + 7 AS DATE) AS VARCHAR) ELSE asserted_value END AS value FROM x_evid CROSS JOIN (SELECT 1 AS v UNION ALL SELECT 2)) WHERE is_quarantined OR value IN ({", ".join(f"'{p}'" for p in _POISON)})"""))

_EV2 = ("ev2", """SELECT document_id, source_id, v, field_name, CASE WHEN v = 1 AND field_name = 'effective_from' AND source_id % 4 = 0
  THEN CAST(CAST(CAST(asserted_value AS DATE) + 7 AS DATE) AS VARCHAR) ELSE asserted_value END AS asserted_value FROM adm CROSS JOIN (SELECT 1 AS v UNION ALL SELECT 2)""")
_SAID2 = ("said2", "SELECT document_id, source_id, v, " + ", ".join(f"min(CASE WHEN field_name = '{f}' THEN asserted_value END) AS {f}" for f in X.EVIDENCE_FIELDS)
          + " FROM ev2 GROUP BY document_id, source_id, v")


def _as_of(name: str, speaks: str) -> tuple[str, str]:
    return name, ("SELECT s.document_id, s.source_id, s.source_authority, z.v, " + ", ".join(f"coalesce(a.{f}, CAST(d.{f} AS VARCHAR)) AS {f}" for f in X.EVIDENCE_FIELDS)
                  + f""" FROM x_srcs s JOIN x_docs d ON d.document_id = s.document_id JOIN (SELECT 1 AS v UNION ALL SELECT 2) z ON z.v = {speaks}
  LEFT JOIN said2 a ON a.document_id = s.document_id AND a.source_id = s.source_id AND a.v = z.v""")


_VERDICT = """SELECT d.document_id, coalesce(n_sources, 0) AS n_sources, coalesce(n_conflicts, 0) AS n_conflicts, coalesce(status, 'unverified') AS status,
  coalesce(high = 0 AND status IN ('cross_verified', 'single_source_verified'), FALSE) AS answerable"""
_NOW = [(n, b.replace("x_asserts", "as_now")) for n, b in (_CONF, _PER, _AG, _VERD)]
_C13_CURRENT = with_views(f"{_VERDICT} FROM x_docs d LEFT JOIN verd v ON v.document_id = d.document_id", _ADM, _EV2, _SAID2,
                          _as_of("as_now", "CASE WHEN s.source_id % 3 = 1 THEN 1 ELSE 2 END"), *_NOW)


def _keys(name: str, asserts: str) -> tuple[str, str]:
    """Conflicts with the snapshots of both sides."""
    return name, f"""SELECT c.document_id, field_name, source_a, a.v AS va, value_a, source_b, b.v AS vb, value_b FROM ({_CONF[1].replace('x_asserts', asserts)}) c
  JOIN {asserts} a ON a.document_id = c.document_id AND a.source_id = c.source_a JOIN {asserts} b ON b.document_id = c.document_id AND b.source_id = c.source_b"""


_C13_INCREMENTAL = with_views(f"""{_VERDICT}, coalesce(n_recorded, 0) AS n_recorded FROM x_docs d LEFT JOIN verd v ON v.document_id = d.document_id
  LEFT JOIN (SELECT document_id, count(*) AS n_recorded FROM (SELECT * FROM keys1 UNION SELECT * FROM keys2) GROUP BY document_id) r ON r.document_id = d.document_id""",
                              _ADM, _EV2, _SAID2, _as_of("as_first", "1"), _as_of("as_now", "CASE WHEN s.source_id % 5 = 0 AND s.source_id % 3 <> 1 THEN 2 ELSE 1 END"), *_NOW,
                              _keys("keys1", "as_first"), _keys("keys2", "as_now"))

QUERIES = {f.__name__: f for f in (c7_intake_run, t7_drift_stream, c13_current_snapshots, c13_incremental, c20_repointed)}
ORACLE = {"c7_intake_run": _C7_RUN, "t7_drift_stream": _T7, "c13_current_snapshots": _C13_CURRENT, "c13_incremental": _C13_INCREMENTAL, "c20_repointed": _C20_REPOINTED}
