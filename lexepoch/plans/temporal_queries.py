"""Queries on status, versions and what sources assert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import evidence, status, verify, versions
from ..sources import tables as X
from ..sources.tables import with_views

DATES = ["1996-01-01", "1997-06-01", "1998-06-01", "1999-12-31", "2000-07-01", "2001-07-01"]
_DATES_SQL = ("dates", " UNION ALL ".join(f"SELECT DATE '{d}' AS as_of" for d in DATES))


def c8_document_status(spark: SparkSession, sf: str) -> DataFrame:
    return status.documents_at(X.x_docs(spark, sf), X.x_rels(spark, sf), DATES)


_FLAGS = ("flags", """SELECT r.target_document_id AS document_id, d.as_of, max(CASE WHEN relationship_type = 'repeals' THEN 1 ELSE 0 END) AS rp,
  max(CASE WHEN relationship_type = 'replaces' THEN 1 ELSE 0 END) AS rl, max(CASE WHEN relationship_type = 'suspends' THEN 1 ELSE 0 END) AS su,
  max(CASE WHEN relationship_type = 'partially_repeals' THEN 1 ELSE 0 END) AS pr, count(*) AS n
  FROM x_rels r JOIN dates d ON (r.effective_from IS NULL OR r.effective_from <= d.as_of) AND (r.effective_to IS NULL OR d.as_of <= r.effective_to)
  WHERE relationship_type <> 'amends' GROUP BY r.target_document_id, d.as_of""")
_STATE = ("state", """SELECT x.document_id, d.as_of, x.document_nature, x.effective_from, CASE WHEN document_nature = 'draft' THEN 'not_yet_effective'
  WHEN effective_from IS NULL THEN 'unknown' WHEN d.as_of < effective_from THEN 'not_yet_effective' WHEN d.as_of > effective_to THEN 'expired'
  WHEN rp = 1 THEN 'repealed' WHEN rl = 1 THEN 'replaced' WHEN su = 1 THEN 'suspended' WHEN pr = 1 THEN 'partially_effective' ELSE 'effective' END AS status, f.n
  FROM x_docs x CROSS JOIN dates d LEFT JOIN flags f ON f.document_id = x.document_id AND f.as_of = d.as_of""")
_C8 = with_views("""SELECT document_id, as_of, status, status IN ('effective', 'partially_effective') AS is_effective,
  CASE WHEN document_nature = 'draft' THEN 'NOT_LAW' WHEN effective_from IS NULL THEN 'MISSING_EFFECTIVE_DATE' WHEN status = 'not_yet_effective' THEN 'FUTURE'
    WHEN status <> 'effective' THEN upper(status) END AS warning,
  CASE WHEN status IN ('repealed', 'replaced', 'suspended', 'partially_effective', 'effective') THEN coalesce(n, 0) ELSE 0 END AS n_affecting FROM state""",
                 _DATES_SQL, _FLAGS, _STATE)


def c9_provision_status(spark: SparkSession, sf: str) -> DataFrame:
    docs, rels, provs = X.x_docs(spark, sf), X.x_rels(spark, sf), X.x_provs(spark, sf)
    return status.provisions_at(provs, status.documents_at(docs, rels, DATES), rels, DATES)


_HITS = ("hits", """SELECT DISTINCT p.provision_id, d.as_of FROM x_provs p JOIN x_rels r ON r.target_document_id = p.document_id
  AND r.relationship_type = 'partially_repeals' JOIN dates d ON r.effective_from <= d.as_of AND (r.effective_to IS NULL OR d.as_of <= r.effective_to)
  WHERE (r.target_article IS NULL OR r.target_article = p.article) AND (r.target_clause IS NULL OR r.target_clause = p.clause)""")
_C9 = with_views("""SELECT p.provision_id, p.document_id, p.article, p.clause, s.as_of, z.status, z.status = 'effective' AS is_effective,
  s.status IN ('repealed', 'replaced', 'not_yet_effective', 'expired', 'suspended') AS inherited
  FROM x_provs p JOIN state s ON s.document_id = p.document_id JOIN (
    SELECT p.provision_id, s.as_of, CASE WHEN s.status IN ('repealed', 'replaced', 'not_yet_effective', 'expired', 'suspended') THEN s.status
      WHEN p.status_override = 'repealed' THEN 'repealed' WHEN s.as_of < p.valid_from THEN 'not_yet_effective' WHEN s.as_of > p.valid_to THEN 'expired'
      WHEN h.provision_id IS NOT NULL THEN 'repealed' ELSE 'effective' END AS status
    FROM x_provs p JOIN state s ON s.document_id = p.document_id LEFT JOIN hits h ON h.provision_id = p.provision_id AND h.as_of = s.as_of) z
  ON z.provision_id = p.provision_id AND z.as_of = s.as_of""", _DATES_SQL, _FLAGS, _STATE, _HITS)


def j8_active_edges(spark: SparkSession, sf: str) -> DataFrame:
    return status.active_edges(X.x_rels(spark, sf), DATES).select("relationship_id", "as_of", "relationship_type")


_J8 = with_views("""SELECT relationship_id, as_of, relationship_type FROM x_rels r JOIN dates d
  ON r.effective_from <= d.as_of AND (r.effective_to IS NULL OR d.as_of <= r.effective_to)""", _DATES_SQL)


def j9_partial_repeals(spark: SparkSession, sf: str) -> DataFrame:
    return status.partial_repeals(X.x_provs(spark, sf), X.x_rels(spark, sf), DATES)


_J9 = with_views("SELECT provision_id, as_of FROM hits", _DATES_SQL, _HITS)


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    """Provisions under fewer article numbers, so that several are versions of one."""
    return X.x_provs(spark, sf).withColumn("article", F.concat(F.lit("Điều "), (F.col("provision_id") % 100 % 3).cast("string"))).withColumn(
        "clause", F.coalesce("clause", F.lit("0")))


_V = ("v", """SELECT provision_id, document_id, 'Điều ' || (provision_id % 100 % 3) AS article, coalesce(clause, '0') AS clause, valid_from, valid_to,
  content FROM x_provs""")


def j10_versions_as_of(spark: SparkSession, sf: str) -> DataFrame:
    return versions.as_of(_versions(spark, sf), DATES)


_J10 = with_views("""SELECT document_id, article, clause, as_of, provision_id, content, valid_from, valid_to FROM (
  SELECT v.*, as_of, row_number() OVER (PARTITION BY document_id, article, clause, as_of ORDER BY valid_from DESC NULLS LAST, provision_id DESC) AS n
  FROM v JOIN dates d ON (valid_from IS NULL OR valid_from <= as_of) AND (valid_to IS NULL OR as_of <= valid_to)) WHERE n = 1""", _DATES_SQL, _V)


def w4_version_chain(spark: SparkSession, sf: str) -> DataFrame:
    return versions.chain(_versions(spark, sf))


_W4 = with_views("""SELECT provision_id, document_id, article, clause, valid_from, coalesce(valid_to, lead(valid_from) OVER w) AS closed_to,
  lag(provision_id) OVER w AS previous_id FROM v WINDOW w AS (PARTITION BY document_id, article, clause ORDER BY valid_from NULLS FIRST, provision_id)""", _V)


def c24_compare_versions(spark: SparkSession, sf: str) -> DataFrame:
    return versions.compare(_versions(spark, sf), "1997-06-01", "2000-07-01")


_PICK = """SELECT document_id, article, clause, sha256(coalesce(content, '')) AS h FROM (
  SELECT v.*, row_number() OVER (PARTITION BY document_id, article, clause ORDER BY valid_from DESC NULLS LAST, provision_id DESC) AS n
  FROM v WHERE (valid_from IS NULL OR valid_from <= DATE '{d}') AND (valid_to IS NULL OR DATE '{d}' <= valid_to)) WHERE n = 1"""
_C24 = with_views("""SELECT document_id, article, clause, change, CAST(NULL AS VARCHAR) AS new_article FROM known k
  WHERE NOT EXISTS (SELECT 1 FROM moved m WHERE m.document_id = k.document_id AND ((k.change = 'REMOVED' AND m.article = k.article AND m.clause = k.clause)
    OR (k.change = 'ADDED' AND m.new_article = k.article AND m.new_clause = k.clause)))
  UNION ALL SELECT document_id, article, clause, 'RENUMBERED', new_article FROM moved""", _V,
                  ("old", _PICK.format(d="1997-06-01")), ("new", _PICK.format(d="2000-07-01")),
                  ("known", """SELECT coalesce(o.document_id, n.document_id) AS document_id, coalesce(o.article, n.article) AS article,
  coalesce(o.clause, n.clause) AS clause, o.h AS old_hash, n.h AS new_hash, CASE WHEN o.h IS NULL THEN 'ADDED' WHEN n.h IS NULL THEN 'REMOVED'
  WHEN o.h = n.h THEN 'UNCHANGED' ELSE 'MODIFIED' END AS change
  FROM old o FULL JOIN new n ON o.document_id = n.document_id AND o.article = n.article AND o.clause = n.clause"""),
                  ("gone", "SELECT *, row_number() OVER (PARTITION BY document_id, old_hash ORDER BY article, clause) AS n FROM known WHERE change = 'REMOVED'"),
                  ("came", "SELECT *, row_number() OVER (PARTITION BY document_id, new_hash ORDER BY article, clause) AS n FROM known WHERE change = 'ADDED'"),
                  ("moved", """SELECT g.document_id, g.article, g.clause, c.article AS new_article, c.clause AS new_clause FROM gone g JOIN came c
  ON g.document_id = c.document_id AND g.old_hash = c.new_hash AND g.n = c.n"""))


def c24_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Versions of which every ninth has no content: what became of those is unknown."""
    v = _versions(spark, sf).withColumn("content", F.when(F.col("provision_id") % 9 != 0, F.col("content")))
    return versions.compare(v, "1997-06-01", "2000-07-01")


_C24_GAPS = (_C24.replace("sha256(coalesce(content, '')) AS h", "CASE WHEN provision_id % 9 <> 0 THEN sha256(content) END AS h, 1 AS there")
             .replace("WHEN o.h IS NULL THEN 'ADDED' WHEN n.h IS NULL THEN 'REMOVED'", "WHEN o.there IS NULL THEN 'ADDED' WHEN n.there IS NULL THEN 'REMOVED' WHEN o.h IS NULL OR n.h IS NULL THEN 'UNKNOWN'"))


def c26_known_events(spark: SparkSession, sf: str) -> DataFrame:
    return status.as_known(X.x_events(spark, sf), "2024-01-15 12:00:00", "ts").groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n_known"), F.max("event_date").alias("last_event"))


_C26 = with_views("SELECT document_id, count(*) AS n_known, max(event_date) AS last_event FROM x_events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY document_id")


# -- agreement --------------------------------------------------------------------------------------------------------
_OFF = "('tier_a', 'tier_b')"
_CONF = ("conf", " UNION ALL ".join(
    f"""SELECT a.document_id, '{f}' AS field_name, a.source_id AS source_a, CAST(a.{f} AS VARCHAR) AS value_a, b.source_id AS source_b,
  CAST(b.{f} AS VARCHAR) AS value_b, '{s}' AS severity FROM x_asserts a JOIN x_asserts b ON a.document_id = b.document_id AND a.source_id < b.source_id
  WHERE a.{f} <> b.{f}""" + (f" AND a.source_authority IN {_OFF} AND b.source_authority IN {_OFF}" if o else "") for f, s, o in verify.RULES))


def c10_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return verify.conflicts(X.x_asserts(spark, sf))


def c13_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return verify.verdicts(X.x_asserts(spark, sf))


_PER = ("per", f"""SELECT document_id, count(*) AS n_sources, sum(CASE WHEN source_authority IN {_OFF} THEN 1 ELSE 0 END) AS n_official,
  count(effective_from) AS n_dated, sum(CASE WHEN source_authority IN {_OFF} AND effective_from IS NOT NULL THEN 1 ELSE 0 END) AS n_od FROM x_asserts GROUP BY document_id""")
_AG = ("ag", """SELECT document_id, count(*) AS n, sum(CASE WHEN severity = 'high' THEN 1 ELSE 0 END) AS high,
  sum(CASE WHEN field_name = 'document_number' THEN 1 ELSE 0 END) AS idn, sum(CASE WHEN field_name = 'effective_from' THEN 1 ELSE 0 END) AS dt,
  sum(CASE WHEN field_name = 'effective_to' THEN 1 ELSE 0 END) AS va FROM conf GROUP BY document_id""")
_VERD = ("verd", """SELECT p.document_id, n_sources, CAST(n_official AS BIGINT) AS n_official, coalesce(n, 0) AS n_conflicts, coalesce(idn, 0) = 0 AS identity_passed,
  n_dated > 0 AND coalesce(dt, 0) = 0 AS date_passed, coalesce(va, 0) = 0 AS validity_passed,
  CASE WHEN n_dated = 0 THEN 'unverified' WHEN coalesce(dt, 0) > 0 THEN 'conflicting' WHEN n_od >= 2 THEN 'cross_verified' ELSE 'single_source_verified' END AS date_status,
  CASE WHEN coalesce(n, 0) > 0 THEN 'conflicting' WHEN coalesce(idn, 0) = 0 AND n_dated > 0 THEN CASE WHEN n_sources >= 2 THEN 'cross_verified' ELSE 'single_source_verified' END
    WHEN coalesce(idn, 0) = 0 THEN 'single_source_verified' ELSE 'unverified' END AS status, coalesce(high, 0) AS high
  FROM per p LEFT JOIN ag a ON a.document_id = p.document_id""")
_C13 = with_views("""SELECT document_id, n_sources, n_official, n_conflicts, identity_passed, date_passed, validity_passed, date_status, status,
  high = 0 AND status IN ('cross_verified', 'single_source_verified') AS answerable FROM verd""", _CONF, _PER, _AG, _VERD)


def p4_admissible_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return verify.admissible(X.x_evid(spark, sf)).select("document_id", "source_id", "field_name", "asserted_value")


def f28_locator_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence with locators: JSON with flags, JSON without, and plain text; flagged and synthetic evidence may not speak."""
    s = F.col("source_id")
    locator = (F.when(s % 7 == 0, F.lit('{"is_test_fixture": true}')).when(s % 5 == 0, F.lit('{"page": 3, "is_quarantined": true}'))
               .when(s % 3 == 0, F.lit("Điều 1")).when(s % 2 == 0, F.lit('{"is_quarantined": false}')))
    e = X.x_evid(spark, sf).withColumn("evidence_locator", locator).withColumn("evidence_type", F.when(s % 11 == 0, F.lit("synthetic_conflict")))
    return verify.admissible(e).select("document_id", "source_id", "field_name")


_ADM = ("adm", "SELECT * FROM x_evid WHERE NOT is_quarantined AND environment = 'production' AND evidence_origin IN ('live_official', 'imported_official')")
_P4 = with_views("SELECT document_id, source_id, field_name, asserted_value FROM adm", _ADM)


def w3_first_values(spark: SparkSession, sf: str) -> DataFrame:
    return verify.first_values(verify.admissible(X.x_evid(spark, sf)), X.EVIDENCE_FIELDS)


_W3 = with_views("SELECT document_id, snapshot_id, " + ", ".join(f"min(CASE WHEN field_name = '{f}' THEN asserted_value END) AS {f}" for f in X.EVIDENCE_FIELDS)
                 + " FROM adm GROUP BY document_id, snapshot_id", _ADM)


def c13_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return verify.corpus(X.x_docs(spark, sf), X.x_srcs(spark, sf), X.x_evid(spark, sf))


_SAID = ("said", "SELECT document_id, source_id, " + ", ".join(f"min(CASE WHEN field_name = '{f}' THEN asserted_value END) AS {f}" for f in X.EVIDENCE_FIELDS)
         + " FROM adm GROUP BY document_id, source_id")
_AS2 = ("as2", "SELECT s.document_id, s.source_id, s.source_authority, " + ", ".join(f"coalesce(a.{f}, CAST(d.{f} AS VARCHAR)) AS {f}" for f in X.EVIDENCE_FIELDS)
        + " FROM x_srcs s JOIN x_docs d ON d.document_id = s.document_id LEFT JOIN said a ON a.document_id = s.document_id AND a.source_id = s.source_id")
_CORPUS = with_views("""SELECT d.document_id, coalesce(n_sources, 0) AS n_sources, coalesce(n_conflicts, 0) AS n_conflicts, coalesce(status, 'unverified') AS status,
  coalesce(high = 0 AND status IN ('cross_verified', 'single_source_verified'), FALSE) AS answerable FROM x_docs d LEFT JOIN verd v ON v.document_id = d.document_id""",
                     _ADM, _SAID, _AS2, *[(n, b.replace("x_asserts", "as2")) for n, b in (_CONF, _PER, _AG, _VERD)])


def a12_unique_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return verify.unique_conflicts(c10_conflicts(spark, sf))


_UNI = ("uni", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, field_name ORDER BY source_a, source_b) AS rn FROM conf) WHERE rn = 1")
_COLS = "document_id, field_name, source_a, value_a, source_b, value_b, severity"


def p9_active_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    found = c10_conflicts(spark, sf).withColumn("resolved", F.col("source_a") % 5 == 0).withColumn(
        "conflict_type", F.when(F.col("source_b") % 7 == 0, "SYNTHETIC_TEST_CONFLICT").otherwise("VALUE_MISMATCH"))
    return verify.active_conflicts(found).drop("resolved", "conflict_type")


def p10_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return verify.candidates(X.x_docs(spark, sf), 50).select("document_id", "issued_date")


def c18_dossiers(spark: SparkSession, sf: str) -> DataFrame:
    return verify.dossiers(c10_conflicts(spark, sf), X.x_srcs(spark, sf))


_C18 = with_views("""SELECT 'DOSSIER-' || u.document_id || '-' || upper(replace(field_name, '_', '-')) AS dossier_id, u.document_id, field_name, severity,
  source_a, sa.source_authority AS authority_a, value_a, source_b, sb.source_authority AS authority_b, value_b,
  CASE WHEN field_name <> 'document_number' THEN least(value_a, value_b) END AS uncertain_from,
  CASE WHEN field_name <> 'document_number' THEN greatest(value_a, value_b) END AS uncertain_to, FALSE AS field_answerable
  FROM uni u LEFT JOIN x_srcs sa ON sa.document_id = u.document_id AND sa.source_id = source_a
  LEFT JOIN x_srcs sb ON sb.document_id = u.document_id AND sb.source_id = source_b""", _CONF, _UNI)
_CLAIM_FIELDS = ["document_number", "title", "issuer_name", "issued_date", "effective_from", "effective_to"]


def c19_claims(spark: SparkSession, sf: str) -> DataFrame:
    return verify.claims(X.x_docs(spark, sf), c10_conflicts(spark, sf), _CLAIM_FIELDS)


_C19 = with_views("""SELECT e.document_id, e.field_name, e.value, e.value IS NOT NULL AND c.document_id IS NULL AS answerable FROM e
  LEFT JOIN (SELECT DISTINCT document_id, field_name FROM conf) c ON c.document_id = e.document_id AND c.field_name = e.field_name""", _CONF,
                  ("e", " UNION ALL ".join(f"SELECT document_id, '{f}' AS field_name, CAST({f} AS VARCHAR) AS value FROM x_docs" for f in _CLAIM_FIELDS)))


def c25_verify_claims(spark: SparkSession, sf: str) -> DataFrame:
    d = X.x_docs(spark, sf)
    asked = d.select(F.col("document_id").alias("claim_id"), "document_id", F.lit("issued_date").alias("field_name"),
                     F.when(F.col("document_id") % 3 == 0, F.date_add("issued_date", 1)).otherwise(F.col("issued_date")).cast("string").alias("value"))
    return verify.verify_claims(asked, X.x_evid(spark, sf))


_C25 = with_views("""SELECT a.document_id AS claim_id, a.document_id, 'issued_date' AS field_name, a.value, CASE WHEN n IS NULL THEN 'insufficient_evidence'
  WHEN hit = 1 AND n = 1 THEN 'supported' WHEN hit = 0 THEN 'contradicted' ELSE 'insufficient_evidence' END AS verdict
  FROM asked a LEFT JOIN (SELECT s.document_id, count(DISTINCT asserted_value) AS n, max(CASE WHEN asserted_value = q.value THEN 1 ELSE 0 END) AS hit
    FROM adm s JOIN asked q ON q.document_id = s.document_id WHERE field_name = 'issued_date' GROUP BY s.document_id) e ON e.document_id = a.document_id""",
                  _ADM, ("asked", "SELECT document_id, CAST(CASE WHEN document_id % 3 = 0 THEN CAST(issued_date + 1 AS DATE) ELSE issued_date END AS VARCHAR) AS value FROM x_docs"))


def a11_sources(spark: SparkSession, sf: str) -> DataFrame:
    return X.x_srcs(spark, sf).groupBy("document_id").agg(F.count(F.lit(1)).alias("n_sources"), F.count_if(verify.official()).alias("n_official"))


def c20_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence of one poisoned value is quarantined, then the corpus is verified again."""
    docs, srcs = X.x_docs(spark, sf), X.x_srcs(spark, sf)
    marked, _ = evidence.quarantine(X.x_evid(spark, sf), c10_conflicts(spark, sf), ["1997-03-01", "1998-07-15"])
    return verify.corpus(docs, srcs, marked)


_ADM20 = ("adm", _ADM[1] + " AND asserted_value NOT IN ('1997-03-01', '1998-07-15')")
_C20 = _CORPUS.replace(_ADM[1], _ADM20[1])


def c3_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.from_metadata(X.x_docs(spark, sf), X.x_provs(spark, sf)).select("document_id", "provision_id", "field_name", "asserted_value", "locator")


_EV = ("ev", " UNION ALL ".join(f"SELECT document_id, CAST(NULL AS BIGINT) AS provision_id, '{f}' AS field_name, CAST({f} AS VARCHAR) AS asserted_value, CAST(NULL AS VARCHAR) AS locator FROM x_docs WHERE {f} IS NOT NULL"
                                for f in evidence.METADATA_FIELDS)
       + " UNION ALL SELECT document_id, provision_id, 'content', substr(content, 1, 500), article || coalesce(' ' || clause, '') FROM x_provs")


def c4_record_evidence(spark: SparkSession, sf: str) -> DataFrame:
    a = X.x_asserts(spark, sf).select("document_id", F.col("source_id").alias("snapshot_id"), "document_number", "issued_date",
                                      F.col("effective_from").alias("effective_date"), F.col("effective_to").alias("expiration_date"))
    return evidence.from_records(a).drop("evidence_type")


_C4 = with_views(" UNION ALL ".join(f"SELECT document_id, source_id AS snapshot_id, '{n}' AS field_name, CAST({f} AS VARCHAR) AS asserted_value FROM x_asserts WHERE {f} IS NOT NULL"
                                    for n, f in (("document_number", "document_number"), ("issued_date", "issued_date"), ("effective_date", "effective_from"), ("expiration_date", "effective_to"))))


def j11_provision_evidence(spark: SparkSession, sf: str) -> DataFrame:
    p = X.x_provs(spark, sf)
    return evidence.for_provisions(p, evidence.from_metadata(X.x_docs(spark, sf), p)).select("provision_id", "n_evidence")


QUERIES = {f.__name__: f for f in (
    c8_document_status, c9_provision_status, j8_active_edges, j9_partial_repeals, j10_versions_as_of, w4_version_chain, c24_compare_versions, c24_with_gaps, c26_known_events,
    c10_conflicts, c13_verdicts, p4_admissible_evidence, f28_locator_flags, w3_first_values, c13_corpus, a12_unique_conflicts, p9_active_conflicts, p10_candidates, c18_dossiers,
    c19_claims, c25_verify_claims, a11_sources, c20_quarantine, c3_evidence, c4_record_evidence, j11_provision_evidence)}
ORACLE = {
    "c8_document_status": _C8, "c9_provision_status": _C9, "j8_active_edges": _J8, "j9_partial_repeals": _J9, "j10_versions_as_of": _J10, "w4_version_chain": _W4,
    "c24_compare_versions": _C24, "c24_with_gaps": _C24_GAPS, "c26_known_events": _C26, "c10_conflicts": with_views(f"SELECT {_COLS} FROM conf", _CONF), "c13_verdicts": _C13,
    "p4_admissible_evidence": _P4,
    "f28_locator_flags": with_views("SELECT document_id, source_id, field_name FROM adm WHERE source_id % 7 <> 0 AND source_id % 5 <> 0 AND source_id % 11 <> 0", _ADM), "w3_first_values": _W3, "c13_corpus": _CORPUS, "a12_unique_conflicts": with_views(f"SELECT {_COLS} FROM uni", _CONF, _UNI),
    "p9_active_conflicts": with_views(f"SELECT {_COLS} FROM conf WHERE source_a % 5 <> 0 AND source_b % 7 <> 0", _CONF),
    "p10_candidates": with_views("SELECT document_id, issued_date FROM x_docs WHERE verification_status = 'single_source_verified' AND document_nature = 'normative_legal_document' ORDER BY issued_date DESC, document_id LIMIT 50"),
    "c18_dossiers": _C18, "c19_claims": _C19, "c25_verify_claims": _C25,
    "a11_sources": with_views(f"SELECT document_id, count(*) AS n_sources, sum(CASE WHEN source_authority IN {_OFF} THEN 1 ELSE 0 END) AS n_official FROM x_srcs GROUP BY document_id"),
    "c20_quarantine": _C20, "c3_evidence": with_views("SELECT * FROM ev", _EV), "c4_record_evidence": _C4,
    "j11_provision_evidence": with_views("""SELECT provision_id, count(*) AS n_evidence FROM (SELECT p.provision_id FROM x_provs p JOIN ev e ON e.document_id = p.document_id
      AND (e.provision_id IS NULL OR e.provision_id = p.provision_id)) GROUP BY provision_id""", _EV)}
