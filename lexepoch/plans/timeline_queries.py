"""Queries on status over time, with dates and moments of knowledge from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import timeline
from ..sources import tables as X
from ..sources.tables import with_views


def _lines_asked(spark: SparkSession, sf: str) -> DataFrame:
    """Every line's document, and the one it refers to, on the day it was shipped, as often as lines say so."""
    n = X.load(spark, sf, "orders").count()
    line = X.load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("as_of"))
    other = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % F.lit(max(n, 1))
    return line.select(F.col("l_orderkey").alias("document_id"), "as_of").union(line.select(other, "as_of"))


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return _lines_asked(spark, sf).distinct()


_ASKED = ("asked", """SELECT DISTINCT document_id, as_of FROM (SELECT l_orderkey AS document_id, CAST(l_shipdate AS DATE) AS as_of FROM lineitem
  UNION ALL SELECT (l_orderkey * 7 + l_linenumber) % (SELECT count(*) FROM orders), CAST(l_shipdate AS DATE) FROM lineitem)""")
_STATUS = """CASE WHEN document_nature = 'draft' THEN 'not_yet_effective' WHEN effective_from IS NULL THEN 'unknown' WHEN as_of < effective_from THEN 'not_yet_effective'
  WHEN as_of > effective_to THEN 'expired' WHEN rp = 1 THEN 'repealed' WHEN rl = 1 THEN 'replaced' WHEN su = 1 THEN 'suspended' WHEN pr = 1 THEN 'partially_effective' ELSE 'effective' END"""
_KINDS = ", ".join(f"max(CASE WHEN relationship_type = '{t}' THEN 1 ELSE 0 END) AS {n}" for t, n in (("repeals", "rp"), ("replaces", "rl"), ("suspends", "su"), ("partially_repeals", "pr")))
_OUT = """status, status IN ('effective', 'partially_effective') AS is_effective,
  CASE WHEN document_nature = 'draft' THEN 'NOT_LAW' WHEN effective_from IS NULL THEN 'MISSING_EFFECTIVE_DATE' WHEN status = 'not_yet_effective' THEN 'FUTURE' WHEN status <> 'effective' THEN upper(status) END AS warning,
  CASE WHEN status IN ('repealed', 'replaced', 'suspended', 'partially_effective', 'effective') THEN coalesce(n, 0) ELSE 0 END AS n_affecting"""


def c8_status_of_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The status of (document, date) pairs of a table, by one timeline of every document."""
    return timeline.status_at(_asked(spark, sf), timeline.timeline(X.x_docs(spark, sf), X.x_rels(spark, sf)))


_C8_PAIRS = with_views(f"""SELECT document_id, as_of, {_OUT} FROM (SELECT a.document_id, a.as_of, document_nature, effective_from, n, {_STATUS} AS status
  FROM asked a JOIN x_docs d ON d.document_id = a.document_id LEFT JOIN flags f ON f.fd = a.document_id AND f.fa = a.as_of)""", _ASKED,
                       ("flags", f"""SELECT a.document_id AS fd, a.as_of AS fa, count(*) AS n, {_KINDS} FROM asked a JOIN x_rels r ON r.target_document_id = a.document_id
  WHERE relationship_type <> 'amends' AND r.effective_from <= a.as_of AND (r.effective_to IS NULL OR a.as_of <= r.effective_to) GROUP BY a.document_id, a.as_of"""))


def c8_timeline(spark: SparkSession, sf: str) -> DataFrame:
    """How many days each document spends in each state between its first and its last change of state."""
    line = timeline.timeline(X.x_docs(spark, sf), X.x_rels(spark, sf)).where("starts > DATE '0001-01-01' AND ends < DATE '9999-12-31'")
    return line.groupBy("document_id", "status").agg(F.sum(F.date_diff("ends", "starts") + 1).alias("days"))


#: Every day on which something may change is judged by itself, from all edges that are active on it.
_C8_TIMELINE = with_views(f"""SELECT document_id, status, sum(next_day - as_of)::BIGINT AS days FROM (
    SELECT *, lead(as_of) OVER (PARTITION BY document_id ORDER BY as_of) AS next_day FROM (
      SELECT *, lag((status, n_affecting)) OVER (PARTITION BY document_id ORDER BY as_of) AS before FROM (
        SELECT document_id, as_of, {_OUT} FROM (SELECT d.document_id, y.as_of, document_nature, effective_from, n, {_STATUS} AS status
          FROM x_docs d JOIN days y ON y.document_id = d.document_id LEFT JOIN flags f ON f.fd = d.document_id AND f.fa = y.as_of)))
    WHERE before IS NULL OR before IS DISTINCT FROM (status, n_affecting))
  WHERE as_of > DATE '1990-01-01' AND next_day IS NOT NULL GROUP BY document_id, status""",
                          ("days", """SELECT DISTINCT document_id, CAST(as_of AS DATE) AS as_of FROM (SELECT document_id, unnest([DATE '1990-01-01', effective_from, CAST(effective_to + 1 AS DATE)]) AS as_of FROM x_docs
  UNION ALL SELECT target_document_id, unnest([effective_from, CAST(effective_to + 1 AS DATE)]) FROM x_rels) WHERE as_of IS NOT NULL"""),
                          ("flags", f"""SELECT y.document_id AS fd, y.as_of AS fa, count(*) AS n, {_KINDS} FROM x_rels r JOIN days y ON r.target_document_id = y.document_id AND r.effective_from <= y.as_of
  AND (r.effective_to IS NULL OR y.as_of <= r.effective_to) WHERE relationship_type <> 'amends' GROUP BY y.document_id, y.as_of"""))


# -- both axes --------------------------------------------------------------------------------------------------------
def _history(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents known ten days after issue, a third corrected later; edges known after they start, a quarter of them given an end or withdrawn later."""
    d, r = X.x_docs(spark, sf), X.x_rels(spark, sf)
    record = lambda start, after: F.struct(start.alias("effective_from"), F.date_add("issued_date", after).alias("recorded_at"))
    first, corrected = record(F.col("effective_from"), 10), record(F.date_add("effective_from", 30), 400)
    docs = d.select("document_id", "document_nature", "effective_to", F.explode(F.array_compact(F.array(first, F.when(F.col("document_id") % 3 == 0, corrected)))).alias("x"))
    edge = lambda kind, end, after: F.struct(kind.alias("relationship_type"), end.alias("effective_to"), F.date_add("effective_from", after).alias("recorded_at"))
    gone = F.when(F.col("relationship_id") % 8 != 0, F.col("relationship_type"))
    early, later = edge(F.col("relationship_type"), F.col("effective_to"), 100), edge(gone, F.date_add("effective_from", 50), 200)
    edges = r.select("relationship_id", "target_document_id", "effective_from", F.explode(F.array_compact(F.array(early, F.when(F.col("relationship_id") % 4 == 0, later)))).alias("x"))
    return (timeline.rectangles(docs.select("document_id", "document_nature", "x.effective_from", "effective_to", "x.recorded_at"), ["document_id"]),
            timeline.rectangles(edges.select("relationship_id", "target_document_id", "x.relationship_type", "effective_from", "x.effective_to", "x.recorded_at"), ["relationship_id"]))


def c26_both_axes(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of document and date, each asked at five moments of knowledge."""
    asked = _lines_asked(spark, sf).repartition("document_id").distinct().withColumn("knowledge_at", F.array(*[F.date_add("as_of", n) for n in (-100, 0, 60, 150, 1000)]))
    docs, rels = _history(spark, sf)
    return timeline.documents_at_both(asked, docs, rels)


_C26_BOTH = with_views(f"""SELECT document_id, as_of, knowledge_at, coalesce(status, 'unknown') AS status, coalesce(is_effective, FALSE) AS is_effective,
  CASE WHEN status IS NULL THEN 'NOT_KNOWN' ELSE warning END AS warning, coalesce(n_affecting, 0) AS n_affecting FROM (
  SELECT a.document_id, a.as_of, a.knowledge_at, k.status, is_effective, warning, n_affecting FROM asked5 a LEFT JOIN (
    SELECT document_id, as_of, knowledge_at, {_OUT} FROM (SELECT a.document_id, a.as_of, a.knowledge_at, document_nature, effective_from, n, {_STATUS} AS status
      FROM asked5 a JOIN dh d ON d.document_id = a.document_id AND d.recorded_at <= a.knowledge_at AND (d.replaced_at IS NULL OR a.knowledge_at < d.replaced_at)
      LEFT JOIN flags f ON f.fd = a.document_id AND f.fa = a.as_of AND f.fk = a.knowledge_at)) k
  ON k.document_id = a.document_id AND k.as_of = a.as_of AND k.knowledge_at = a.knowledge_at)""", _ASKED,
                       ("asked5", "SELECT document_id, as_of, CAST(as_of + n AS DATE) AS knowledge_at FROM asked CROSS JOIN (SELECT unnest([-100, 0, 60, 150, 1000])::INT AS n)"),
                       ("dh", """SELECT document_id, document_nature, effective_from, effective_to, CAST(issued_date + 10 AS DATE) AS recorded_at, CASE WHEN document_id % 3 = 0 THEN CAST(issued_date + 400 AS DATE) END AS replaced_at FROM x_docs
  UNION ALL SELECT document_id, document_nature, CAST(effective_from + 30 AS DATE), effective_to, CAST(issued_date + 400 AS DATE), NULL FROM x_docs WHERE document_id % 3 = 0"""),
                       ("rh", """SELECT target_document_id, relationship_type, effective_from, effective_to, effective_from + 100 AS recorded_at, CASE WHEN relationship_id % 4 = 0 THEN effective_from + 200 END AS replaced_at FROM x_rels
  UNION ALL SELECT target_document_id, relationship_type, effective_from, CAST(effective_from + 50 AS DATE), effective_from + 200, NULL FROM x_rels WHERE relationship_id % 4 = 0 AND relationship_id % 8 <> 0"""),
                       ("flags", f"""SELECT a.document_id AS fd, a.as_of AS fa, a.knowledge_at AS fk, count(*) AS n, {_KINDS} FROM asked5 a JOIN rh r ON r.target_document_id = a.document_id
  WHERE relationship_type <> 'amends' AND r.effective_from <= a.as_of AND (r.effective_to IS NULL OR a.as_of <= r.effective_to) AND r.recorded_at <= a.knowledge_at AND (r.replaced_at IS NULL OR a.knowledge_at < r.replaced_at)
  GROUP BY a.document_id, a.as_of, a.knowledge_at"""))

QUERIES = {f.__name__: f for f in (c8_status_of_pairs, c8_timeline, c26_both_axes)}
ORACLE = {"c8_status_of_pairs": _C8_PAIRS, "c8_timeline": _C8_TIMELINE, "c26_both_axes": _C26_BOTH}
