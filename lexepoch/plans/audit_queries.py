"""Queries on accounting, quality and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..operators import audit, segment, snapshots, status, verify
from ..sources import tables as X
from ..sources.tables import with_views
from .temporal_queries import _AG, _CONF, _DATES_SQL, _FLAGS, _PER, _STATE, _VERD, DATES, c8_document_status
from .text_queries import _articles

_DIMS = ["document_type", "document_nature", "issuer_name", "verification_status"]


def a1_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return audit.distribution(X.x_docs(spark, sf), _DIMS)


_A1 = with_views(" UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS value, count(*) AS n FROM x_docs GROUP BY {d}" for d in _DIMS))


def a2_by_year(spark: SparkSession, sf: str) -> DataFrame:
    return audit.by_year(X.x_docs(spark, sf).withColumn("issued_date", F.when(F.col("document_id") % 50 != 0, F.col("issued_date"))))


_A2 = with_views("SELECT coalesce(CASE WHEN document_id % 50 <> 0 THEN CAST(year(issued_date) AS VARCHAR) END, 'UNKNOWN') AS year, count(*) AS n FROM x_docs GROUP BY 1")


def a3_missing_counts(spark: SparkSession, sf: str) -> DataFrame:
    return audit.missing_counts(X.x_docs(spark, sf), ["document_number", "effective_from", "effective_to"])


_A3 = with_views("""SELECT count(*) AS total, sum(CASE WHEN document_number IS NULL THEN 1 ELSE 0 END) AS missing_document_number,
  sum(CASE WHEN effective_from IS NULL THEN 1 ELSE 0 END) AS missing_effective_from, sum(CASE WHEN effective_to IS NULL THEN 1 ELSE 0 END) AS missing_effective_to FROM x_docs""")


def p7_missing(spark: SparkSession, sf: str) -> DataFrame:
    return audit.missing(X.x_docs(spark, sf), ["document_number", "effective_from"])


_P7 = with_views("SELECT document_id, 'effective_from' AS missing FROM x_docs WHERE effective_from IS NULL")


def p8_unknown_year(spark: SparkSession, sf: str) -> DataFrame:
    d = X.x_docs(spark, sf).withColumn("issued_date", F.when(F.col("document_id") % 3 != 0, F.col("issued_date"))).withColumn(
        "document_number", F.when(F.col("document_id") % 2 == 0, F.lit("12/QĐ")).otherwise(F.col("document_number")))
    return audit.unknown_year(d).select("document_id")


_P8 = with_views("SELECT document_id FROM x_docs WHERE document_id % 6 = 0")


def a4_run_delta(spark: SparkSession, sf: str) -> DataFrame:
    t = {"documents": X.x_docs(spark, sf), "provisions": X.x_provs(spark, sf), "relationships": X.x_rels(spark, sf)}
    before = audit.table_counts({k: v.where("document_id % 2 = 0") for k, v in t.items() if k != "relationships"})
    return audit.run_delta(before, audit.table_counts(t))


_A4 = with_views("""SELECT table_name, n_before, n_after, n_after - n_before AS delta FROM (
  SELECT 'documents' AS table_name, sum(CASE WHEN document_id % 2 = 0 THEN 1 ELSE 0 END) AS n_before, count(*) AS n_after FROM x_docs
  UNION ALL SELECT 'provisions', sum(CASE WHEN document_id % 2 = 0 THEN 1 ELSE 0 END), count(*) FROM x_provs UNION ALL SELECT 'relationships', 0, count(*) FROM x_rels)""")


def a5_provision_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return audit.provision_distribution(X.x_provs(spark, sf))


_A5 = with_views("""SELECT count(*) AS documents, sum(n) AS total, round(avg(n), 6) AS mean, floor(quantile_cont(n, 0.5) + 0.5) AS median, round(quantile_cont(n, 0.95), 6) AS p95,
  max(n) AS max, sum(CASE WHEN n = plain THEN 1 ELSE 0 END) AS fallback_only FROM (SELECT document_id, count(*) AS n, sum(CASE WHEN clause IS NULL THEN 1 ELSE 0 END) AS plain FROM x_provs GROUP BY document_id)""")


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """A second source: documents of the years it has indexed, a few of them missing, unavailable or with another date."""
    d = X.x_docs(spark, sf).where("issued_date <= DATE '2000-12-31' AND document_id % 41 <> 0")
    return d.select("document_number", F.when(F.col("document_id") % 37 == 0, F.date_add("issued_date", 1)).otherwise(F.col("issued_date")).alias("issued_date"),
                    (F.col("document_id") % 43 != 0).alias("available"))


def c22_corpus_audit(spark: SparkSession, sf: str) -> DataFrame:
    return audit.audit(X.x_docs(spark, sf), _records(spark, sf))


_AUD = ("aud", """SELECT document_id, document_type, document_nature, issuer_name, CAST(year(issued_date) AS VARCHAR) AS year,
  CASE WHEN issued_date > DATE '2000-12-31' THEN CASE WHEN issued_date > (SELECT max(CASE WHEN document_id % 37 = 0 THEN CAST(issued_date + 1 AS DATE) ELSE issued_date END) FROM x_docs
    WHERE issued_date <= DATE '2000-12-31' AND document_id % 41 <> 0) THEN 'NOT_YET_INDEXED' ELSE 'NO_MATCH' END
  WHEN document_id % 41 = 0 THEN CASE WHEN issued_date > (SELECT max(CASE WHEN document_id % 37 = 0 THEN CAST(issued_date + 1 AS DATE) ELSE issued_date END) FROM x_docs
    WHERE issued_date <= DATE '2000-12-31' AND document_id % 41 <> 0) THEN 'NOT_YET_INDEXED' ELSE 'NO_MATCH' END
  WHEN document_id % 43 = 0 THEN 'UNAVAILABLE' WHEN document_id % 37 = 0 THEN 'MISMATCH' ELSE 'MATCHED' END AS state FROM x_docs""")
_C22 = with_views("SELECT * FROM aud", _AUD)


def a6_accounting(spark: SparkSession, sf: str) -> DataFrame:
    return audit.accounting(c22_corpus_audit(spark, sf))


_SUM = ("summ", "SELECT count(*) AS total, " + ", ".join(f"sum(CASE WHEN state = '{s}' THEN 1 ELSE 0 END) AS {s.lower()}" for s in audit.STATES) + ", 0 AS silent_drops FROM aud")


def a7_accounting_by(spark: SparkSession, sf: str) -> DataFrame:
    return audit.accounting_by(c22_corpus_audit(spark, sf), ["document_type", "issuer_name", "year", "document_nature"])


_A7 = with_views(" UNION ALL ".join(f"""SELECT '{d}' AS dimension, {d} AS value, count(*) AS total, sum(CASE WHEN state = 'MATCHED' THEN 1 ELSE 0 END) AS matched,
  round(sum(CASE WHEN state = 'MATCHED' THEN 1 ELSE 0 END) * 100.0 / count(*), 6) AS match_rate FROM aud GROUP BY {d}""" for d in ("document_type", "issuer_name", "year", "document_nature")), _AUD)


def a8_gates(spark: SparkSession, sf: str) -> DataFrame:
    return audit.gates(a6_accounting(spark, sf))


_A8 = with_views("""SELECT 'match_rate' AS gate, 98.0 AS target, r AS actual, r >= 98 AS passed FROM (SELECT round(matched * 100.0 / (total - not_yet_indexed - unavailable), 6) AS r FROM summ)
  UNION ALL SELECT 'silent_drops', 0.0, 0.0, TRUE UNION ALL SELECT 'mismatches', 0.0, mismatch, mismatch = 0 FROM summ""", _AUD, _SUM)


def c21_backfill(spark: SparkSession, sf: str) -> DataFrame:
    d = X.x_docs(spark, sf).withColumn("issued_date", F.when(F.col("document_id") % 4 != 0, F.col("issued_date"))).withColumn(
        "title", F.when(F.col("document_id") % 8 == 0, F.lit("Không rõ")).otherwise(F.concat("title", F.lit(" năm 2019"))))
    e = verify.admissible(X.x_evid(spark, sf))
    return audit.backfill(d, e, 1990).select("document_id", "issued_date", "imputed")


_C21 = with_views("""SELECT d.document_id, coalesce(CASE WHEN d.document_id % 4 <> 0 THEN d.issued_date END, said, CASE WHEN d.document_id % 8 = 0 THEN DATE '1990-01-01' ELSE DATE '2019-01-01' END) AS issued_date,
  d.document_id % 4 = 0 AND said IS NULL AS imputed FROM x_docs d LEFT JOIN (SELECT document_id, min(CAST(asserted_value AS DATE)) AS said FROM x_evid
  WHERE field_name = 'issued_date' AND NOT is_quarantined AND environment = 'production' AND evidence_origin <> 'synthetic_fixture' GROUP BY document_id) s ON s.document_id = d.document_id""")


def _bad_records(spark: SparkSession, sf: str) -> DataFrame:
    d = X.load(spark, sf, "documents")
    i = F.col("doc_id")
    return d.select(i.alias("item"), "source", F.when(i % 11 != 0, F.concat(i.cast("string"), F.lit("/2020/TT"))).alias("document_number"),
                    F.when(i % 13 != 0, F.substring("text", 1, 20)).alias("title"), F.when(i % 17 != 0, F.concat(F.lit("https://x.example/"), i.cast("string"))).alias("url"),
                    F.when(i % 19 != 0, F.lit("2020-01-01")).alias("effective_date"), F.when(i % 5 != 0, F.col("lang")).alias("issuer"))


def p5_validate(spark: SparkSession, sf: str) -> DataFrame:
    return audit.validate(_bad_records(spark, sf))


_P5 = """SELECT doc_id AS item, CASE WHEN doc_id % 11 = 0 THEN 'FAIL_CLOSED: Missing required document_number' WHEN doc_id % 13 = 0 OR trim(substr(text, 1, 20)) = '' THEN
  'FAIL_CLOSED: Missing required title' WHEN doc_id % 17 = 0 THEN 'FAIL_CLOSED: Missing valid source locator URL' END AS reason FROM documents"""


def a9_drift(spark: SparkSession, sf: str) -> DataFrame:
    return audit.drift(_bad_records(spark, sf), "source")


_A9 = """SELECT source, total, extraction_rate, identity_rate, effective_rate, issuer_rate, failures, flags, CASE WHEN flags <> '' THEN 'DEGRADED' ELSE 'HEALTHY' END AS circuit FROM (
  SELECT *, concat_ws(',', CASE WHEN extraction_rate < 98 THEN 'SCHEMA_CHANGED' END, CASE WHEN effective_rate < 95 THEN 'EFFECTIVE_DATE_COVERAGE_LOW' END,
    CASE WHEN failures > 1 AND total > 10 THEN 'SELECTOR_FAILURES' END) AS flags FROM (
  SELECT source, count(*) AS total, round(sum(c) * 100.0 / count(*), 6) AS extraction_rate, round(sum(CASE WHEN doc_id % 11 <> 0 THEN 1 ELSE 0 END) * 100.0 / count(*), 6) AS identity_rate,
    round(sum(CASE WHEN doc_id % 19 <> 0 THEN 1 ELSE 0 END) * 100.0 / count(*), 6) AS effective_rate, round(sum(CASE WHEN doc_id % 5 <> 0 THEN 1 ELSE 0 END) * 100.0 / count(*), 6) AS issuer_rate,
    count(*) - sum(c) AS failures FROM (SELECT *, CASE WHEN doc_id % 11 <> 0 AND doc_id % 13 <> 0 AND doc_id % 19 <> 0 AND trim(substr(text, 1, 20)) <> '' THEN 1 ELSE 0 END AS c FROM documents) GROUP BY source))"""


def a10_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    p = X.load(spark, sf, "pages")
    marked = audit.fingerprint(p).join(p.select("page_id", (F.col("page_id") % 5).alias("site")), "page_id")
    return audit.fingerprint_shifts(marked, "site", "page_id")


_A10 = """SELECT page_id, fingerprint, site, lag(fingerprint) OVER w AS previous, coalesce(lag(fingerprint) OVER w <> fingerprint, FALSE) AS shifted FROM (
  SELECT page_id, page_id % 5 AS site, substr(sha256(array_to_string(list_slice(list_filter(list_transform(regexp_extract_all(html, '<([a-zA-Z0-9]+)[^>]*>', 1), lambda t: lower(t)),
    lambda t: t <> 'script' AND t <> 'style'), 1, 100), '>')), 1, 16) AS fingerprint FROM pages) WINDOW w AS (PARTITION BY site ORDER BY page_id)"""


def a13_pipeline_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Articles, clauses and documents with several provisions, from segmented texts."""
    p = segment.provisions(_articles(spark, sf))
    per = p.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sort_key").alias("k"), F.count("clause").alias("c"))
    return per.agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col("n") > 1).alias("structured"), F.sum("n").alias("provisions"), F.sum("c").alias("clauses"))


_A13 = with_views("""SELECT count(*) AS processed, sum(CASE WHEN n + c > 1 THEN 1 ELSE 0 END) AS structured, sum(n + c) AS provisions, sum(c) AS clauses FROM (
  SELECT document_id, count(*) AS n, count(clause) AS c FROM x_provs GROUP BY document_id)""")


def _ranked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Vectors of a label ranked by their first coordinate; those of the same label are relevant."""
    e = X.load(spark, sf, "embeddings").select("vec_id", "label", F.round(F.element_at("embedding", 1), 6).alias("x"))
    lists = e.select((F.col("vec_id") % 8).alias("query_id"), F.col("vec_id").alias("item"), "label", "x")
    w = Window.partitionBy("query_id").orderBy(F.col("x").desc(), "item")
    ranked = lists.withColumn("rank", F.row_number().over(w)).select("query_id", "item", "rank")
    return ranked, lists.select("query_id", "item", (F.col("label") == F.col("query_id")).alias("relevant"))


def a14_retrieval_quality(spark: SparkSession, sf: str) -> DataFrame:
    return audit.retrieval(*_ranked(spark, sf))


_A14 = """WITH l AS (SELECT vec_id % 8 AS query_id, vec_id AS item, CASE WHEN label = vec_id % 8 THEN 1 ELSE 0 END AS rel,
  row_number() OVER (PARTITION BY vec_id % 8 ORDER BY round(CAST(embedding[1] AS DOUBLE), 6) DESC, vec_id) AS rank FROM embeddings),
p AS (SELECT query_id, sum(CASE WHEN rank <= 5 THEN rel ELSE 0 END) AS h5, sum(CASE WHEN rank <= 10 THEN rel ELSE 0 END) AS h10, min(CASE WHEN rel = 1 THEN rank END) AS best,
  sum(CASE WHEN rank <= 10 AND rel = 1 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, sum(rel) AS n FROM l GROUP BY query_id HAVING sum(rel) > 0),
i AS (SELECT query_id, sum(1 / log2(k + 1)) AS idcg FROM p, (SELECT unnest(range(1, 11)) AS k) WHERE k <= n GROUP BY query_id)
SELECT count(*) AS queries, round(avg(h5 / 5.0), 6) AS p_at_5, round(avg(h10 / 10.0), 6) AS p_at_k, round(avg(h10 / CAST(n AS DOUBLE)), 6) AS recall_at_k, round(avg(1.0 / best), 6) AS mrr,
  round(avg(dcg / idcg), 6) AS ndcg_at_k, 0.0 AS duplicate_rate FROM p JOIN i ON i.query_id = p.query_id"""


def a15_safety(spark: SparkSession, sf: str) -> DataFrame:
    docs, rels, asserts = X.x_docs(spark, sf), X.x_rels(spark, sf), X.x_asserts(spark, sf)
    verdicts = verify.verdicts(asserts)
    answered = status.documents_at(docs, rels, DATES).join(verdicts.select("document_id", "answerable"), "document_id")
    return audit.safety(answered, docs, verify.conflicts(asserts).where("severity = 'high'"), asserts)


_A15 = with_views("""SELECT count(*) AS results, 0 AS draft_as_law, 0 AS future_as_current, 0 AS expired_as_current, 0 AS unsupported_answerable, 0 AS hidden_conflict
  FROM (SELECT DISTINCT document_id FROM x_srcs) s JOIN x_docs d ON d.document_id = s.document_id CROSS JOIN dates""", _DATES_SQL)


def a16_temporal_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """States against a golden set that expects every document without incoming edges to follow its own dates."""
    d = status.at_dates(X.x_docs(spark, sf), DATES)
    day = F.col("as_of")
    gold = d.select("document_id", "as_of", F.when(F.col("document_nature") == "draft", "not_yet_effective").when(F.col("effective_from").isNull(), "unknown")
                    .when(day < F.col("effective_from"), "not_yet_effective").when(day > F.col("effective_to"), "expired").otherwise("effective").alias("expected_status"))
    return audit.temporal(c8_document_status(spark, sf), gold)


_A16 = with_views("""SELECT count(*) AS cases, count(*) AS found, round(avg(CASE WHEN status IN ('repealed', 'replaced', 'suspended', 'partially_effective') THEN 0.0 ELSE 1.0 END), 6) AS accuracy
  FROM state""", _DATES_SQL, _FLAGS, _STATE)


def a17_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return audit.coverage(X.x_docs(spark, sf), X.x_provs(spark, sf))


_A17 = with_views("""SELECT CASE WHEN n IS NULL THEN 'metadata_only' WHEN n = 1 THEN 'fallback' ELSE 'structured' END AS class, count(*) AS n FROM x_docs d
  LEFT JOIN (SELECT document_id, count(*) AS n FROM x_provs GROUP BY document_id) p ON p.document_id = d.document_id GROUP BY 1""")


def a18_integrity(spark: SparkSession, sf: str) -> DataFrame:
    d = X.x_docs(spark, sf).where("document_nature <> 'draft'").withColumn("canonical_id", F.concat_ws("|", "issuer_name", F.col("issued_date").cast("string")))
    return audit.domain_integrity(d, X.x_srcs(spark, sf))


_A18 = with_views("""SELECT (SELECT count(*) FROM x_docs WHERE document_nature <> 'draft' AND document_id NOT IN (SELECT document_id FROM x_srcs)) AS orphan_documents,
  (SELECT count(*) FROM (SELECT issuer_name, issued_date FROM x_docs WHERE document_nature <> 'draft' GROUP BY issuer_name, issued_date HAVING count(*) > 1)) AS duplicate_canonical_ids,
  (SELECT count(*) FROM x_srcs WHERE document_id NOT IN (SELECT document_id FROM x_docs WHERE document_nature <> 'draft')) AS sources_without_document""")


def a19_ingestion(spark: SparkSession, sf: str) -> DataFrame:
    return audit.ingestion(snapshots.changes(snapshots.hashed(X.x_snaps(spark, sf))))


_A19 = """SELECT 2 * count(*) AS snapshots, 0.5 AS created_rate, round(sum(CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END) / (2.0 * count(*)), 6) AS mutation_rate,
  round(sum(CASE WHEN doc_id % 10 <> 0 THEN 1 ELSE 0 END) / (2.0 * count(*)), 6) AS duplicate_rate FROM documents"""


def a21_run_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return X.x_docs(spark, sf).where("issued_date >= DATE '2000-01-01'").groupBy("document_nature", "document_type").agg(F.count(F.lit(1)).alias("n"))


_A21 = with_views("SELECT document_nature, document_type, count(*) AS n FROM x_docs WHERE issued_date >= DATE '2000-01-01' GROUP BY document_nature, document_type")


def u4_diff(spark: SparkSession, sf: str) -> DataFrame:
    d = X.x_docs(spark, sf).select("document_id")
    return audit.diff(d.where("document_id % 3 <> 0"), d.where("document_id % 4 <> 0"), ["document_id"])


_U4 = with_views("""SELECT document_id, 'added' AS side FROM x_docs WHERE document_id % 4 <> 0 AND document_id % 3 = 0
  UNION ALL SELECT document_id, 'removed' FROM x_docs WHERE document_id % 3 <> 0 AND document_id % 4 = 0""")


def c27_review_queue(spark: SparkSession, sf: str) -> DataFrame:
    asserts = X.x_asserts(spark, sf)
    return audit.review_queue(verify.conflicts(asserts), verify.corpus(X.x_docs(spark, sf), X.x_srcs(spark, sf), X.x_evid(spark, sf)),
                              snapshots.changes(snapshots.hashed(X.x_snaps(spark, sf))), p5_validate(spark, sf).where("reason IS NOT NULL"))


_C27 = with_views("""SELECT DISTINCT 'conflicts' AS queue, CAST(document_id AS VARCHAR) AS item FROM conf
  UNION ALL SELECT 'unverified', CAST(document_id AS VARCHAR) FROM x_docs WHERE document_id NOT IN (SELECT document_id FROM x_srcs)
  UNION ALL SELECT 'source_changes', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 10 = 0
  UNION ALL SELECT 'parser_errors', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 11 = 0 OR doc_id % 13 = 0 OR doc_id % 17 = 0 OR trim(substr(text, 1, 20)) = ''""", _CONF)


def c30_staleness(spark: SparkSession, sf: str) -> DataFrame:
    m = X.x_events(spark, sf).groupBy(F.col("user_id").cast("string").alias("source_name")).agg(F.max("ts").alias("last_success"))
    return audit.staleness(m, "2024-01-31 00:00:00")


_C30 = with_views("""SELECT CAST(user_id AS VARCHAR) AS source_name, max(ts) AS last_success, max(ts) < TIMESTAMP '2024-01-30 00:00:00' AS stale FROM x_events GROUP BY user_id""")

QUERIES = {f.__name__: f for f in (
    a1_distribution, a2_by_year, a3_missing_counts, p7_missing, p8_unknown_year, a4_run_delta, a5_provision_distribution, c22_corpus_audit, a6_accounting, a7_accounting_by, a8_gates,
    c21_backfill, p5_validate, a9_drift, a10_fingerprints, a13_pipeline_metrics, a14_retrieval_quality, a15_safety, a16_temporal_accuracy, a17_coverage, a18_integrity, a19_ingestion,
    a21_run_histogram, u4_diff, c27_review_queue, c30_staleness)}
ORACLE = {
    "a1_distribution": _A1, "a2_by_year": _A2, "a3_missing_counts": _A3, "p7_missing": _P7, "p8_unknown_year": _P8, "a4_run_delta": _A4, "a5_provision_distribution": _A5,
    "c22_corpus_audit": _C22, "a6_accounting": with_views("SELECT * FROM summ", _AUD, _SUM), "a7_accounting_by": _A7, "a8_gates": _A8, "c21_backfill": _C21, "p5_validate": _P5,
    "a9_drift": _A9, "a10_fingerprints": _A10, "a13_pipeline_metrics": _A13, "a14_retrieval_quality": _A14, "a15_safety": _A15, "a16_temporal_accuracy": _A16, "a17_coverage": _A17,
    "a18_integrity": _A18, "a19_ingestion": _A19, "a21_run_histogram": _A21, "u4_diff": _U4, "c27_review_queue": _C27, "c30_staleness": _C30}
