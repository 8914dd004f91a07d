"""Queries on retrieval, detail and contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import postings, search, status, verify
from ..sources.scratch import kept, new_path
from ..sources import tables as X
from ..sources.tables import with_views
from .temporal_queries import _AG, _CONF, _DATES_SQL, _FLAGS, _PER, _STATE, _VERD

AS_OF = "2000-07-01"
_ONE = ("dates", f"SELECT DATE '{AS_OF}' AS as_of")
#: Questions in the words of the corpus' titles and contents, some with signs in them.
QUESTIONS = ["small ring", "red", "thuế giá trị gia tăng", "hóa đơn", "Bộ Tài chính", "Nghị định", "12/1996/NĐ-CP", "hải quan kế toán", "large bolt", "!!", "economy? standard, 12/2000/NĐ-CP; promo", "Large, small: 31/1998/NĐ-CP", "(economy) 3/1997/NĐ-CP promo?", "small? ring, 17/1999/NĐ-CP"]
_QSQL = ("qs", " UNION ALL ".join(f"SELECT {i} AS query_id, '{q}' AS query" for i, q in enumerate(QUESTIONS)))


def _questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(QUESTIONS)), "query_id int, query string")


def c15_search(spark: SparkSession, sf: str) -> DataFrame:
    """Many questions at once: the ten best documents of each."""
    return search.search(_questions(spark), X.x_docs(spark, sf), X.x_provs(spark, sf), 10)


_NORM = "translate(upper({}), 'Đ', 'D')"
_SEARCH = [_QSQL,
           ("q", rf"""SELECT query_id, lower(trim(query)) AS q, nullif({_NORM.format("regexp_extract(lower(trim(query)), '([0-9]+/[0-9]{4}/[\\p{L}0-9_.-]+)', 1)".replace(chr(92) * 2, chr(92)))}, '') AS qn,
  list_filter(regexp_split_to_array(lower(trim(query)), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS qt FROM qs WHERE regexp_matches(query, '[\p{{L}}\p{{N}}]')"""),
           ("pm", """SELECT query_id, document_id, article, heading, content, row_number() OVER (PARTITION BY query_id, document_id ORDER BY sort_key, provision_id) AS n
  FROM x_provs p JOIN q ON contains(lower(p.content), q.q)"""),
           ("tops", """SELECT query_id, document_id, string_agg('[' || article || coalesce(' - ' || heading, '') || '] ' || substr(content, 1, 200) || '...', ' | ' ORDER BY n) AS snippets FROM pm WHERE n <= 2 GROUP BY query_id, document_id"""),
           ("dd", rf"""SELECT *, {_NORM.format('document_number')} AS nn, regexp_split_to_array(lower(title), '[^\p{{L}}\p{{N}}]+') AS dt FROM x_docs"""),
           ("hit", """SELECT q.query_id, d.document_id FROM dd d JOIN q ON d.nn = q.qn OR contains(lower(d.title), q.q) OR len(list_filter(q.qt, lambda x: NOT list_contains(d.dt, x))) = 0
  UNION SELECT query_id, document_id FROM tops"""),
           ("sc", """SELECT h.query_id, d.*, CAST(round(0.1 + CASE WHEN d.nn = q.qn THEN 0.8 ELSE 0 END + CASE WHEN contains(lower(d.title), q.q) THEN 0.4 ELSE 0 END +
  CASE document_nature WHEN 'normative_legal_document' THEN 0.15 WHEN 'official_guidance' THEN 0.05 ELSE 0 END, 6) AS DOUBLE) AS score
  FROM hit h JOIN dd d ON d.document_id = h.document_id JOIN q ON q.query_id = h.query_id""")]
_C15 = with_views("""SELECT s.query_id, rank, s.document_id, document_number, document_nature, title, score, coalesce(t.snippets, '') AS snippets FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rank FROM sc) s
  LEFT JOIN tops t ON t.query_id = s.query_id AND t.document_id = s.document_id WHERE rank <= 10""", *_SEARCH)


def c15_one_question(spark: SparkSession, sf: str) -> DataFrame:
    """One question alone, as a reader asks it."""
    return search.search(_questions(spark).where("query_id = 3"), X.x_docs(spark, sf), X.x_provs(spark, sf), 10)


_built: dict[tuple[str, str], postings.Index] = {}


def _index(spark: SparkSession, sf: str) -> postings.Index:
    """The index of a folder's documents and provisions, written once a session."""
    at = spark.sparkContext.applicationId, sf
    if at not in _built:
        _built[at] = postings.build(X.x_docs(spark, sf), X.x_provs(spark, sf), new_path(spark, "index"))
    return _built[at]


def k5_indexed_search(spark: SparkSession, sf: str) -> DataFrame:
    """The same questions over the written index."""
    return postings.search(_questions(spark), _index(spark, sf), 10)


def k5_one_question(spark: SparkSession, sf: str) -> DataFrame:
    return postings.search(_questions(spark).where("query_id = 3"), _index(spark, sf), 10)


def k5_question_a_document(spark: SparkSession, sf: str) -> DataFrame:
    """As many questions as documents: every document's number, which longer numbers end with."""
    index = _index(spark, sf)
    asked = index.docs.select(F.col("document_id").alias("query_id"), F.col("document_number").alias("query"))
    return postings.search(asked, index, 10).select("query_id", "rank", "document_id", "score")


#: A question's words are its number, its year and the ending: a title has all of them if number and year are among its own.
_K5_ALL = with_views("""SELECT query_id, rank, document_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rank FROM (
  SELECT query_id, m.document_id, CAST(round(0.1 + max(phrase) + CASE document_nature WHEN 'normative_legal_document' THEN 0.15 WHEN 'official_guidance' THEN 0.05 ELSE 0 END, 6) AS DOUBLE) AS score
  FROM met m JOIN x_docs d ON d.document_id = m.document_id GROUP BY query_id, m.document_id, document_nature)) WHERE rank <= 10""",
                     ("met", """SELECT q.document_id AS query_id, d.document_id, CASE WHEN q.document_id = d.document_id THEN 1.2 ELSE 0.4 END AS phrase
  FROM (SELECT *, substr(document_number, i) AS ending FROM (SELECT *, unnest(range(1, instr(document_number, '/')))::INT AS i FROM x_docs)) d JOIN x_docs q ON q.document_number = d.ending
  UNION ALL SELECT q.document_id, d.document_id, 0 FROM x_docs q JOIN x_docs d ON q.document_id IN (d.document_id, year(d.issued_date)) AND year(q.issued_date) IN (d.document_id, year(d.issued_date))
  WHERE q.document_id BETWEEN 1900 AND 2100"""))
_C15_ONE = _C15 + " AND s.query_id = 3"


def c17_one_question(spark: SparkSession, sf: str) -> DataFrame:
    return search.effective_rules(_questions(spark).where("query_id = 0"), X.x_docs(spark, sf), X.x_provs(spark, sf), X.x_rels(spark, sf), AS_OF, 10)


def c17_effective_rules(spark: SparkSession, sf: str) -> DataFrame:
    return search.effective_rules(_questions(spark), X.x_docs(spark, sf), X.x_provs(spark, sf), X.x_rels(spark, sf), AS_OF, 10)


_HITS = ("hits", """SELECT DISTINCT p.provision_id FROM x_provs p JOIN x_rels r ON r.target_document_id = p.document_id AND r.relationship_type = 'partially_repeals'
  JOIN dates d ON r.effective_from <= d.as_of AND (r.effective_to IS NULL OR d.as_of <= r.effective_to)
  WHERE r.target_article = p.article AND (r.target_clause IS NULL OR r.target_clause = p.clause)""")
_RULES = [_ONE, _FLAGS, _STATE, _HITS, *_SEARCH,
          ("cand", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rk FROM sc
  WHERE document_nature NOT IN ('draft', 'proposal', 'consultation')) WHERE rk <= 20"""),
          ("live", """SELECT c.*, s.as_of, q.q, list_filter(regexp_split_to_array(trim(regexp_replace(q.q, '[^\\p{L}\\p{N}\\s]', ' ', 'g')), '\\s+'), lambda x: length(x) > 1) AS terms FROM cand c
  JOIN state s ON s.document_id = c.document_id AND s.status IN ('effective', 'partially_effective') JOIN q ON q.query_id = c.query_id"""),
          ("ps", """SELECT l.query_id, l.document_nature, l.score AS doc_score, p.*, l.as_of,
  round(CASE WHEN contains(lower(content), l.q) THEN 3.0 WHEN contains(lower(coalesce(heading, '')), l.q) THEN 2.5 ELSE 0 END + 0.5 * len(list_filter(l.terms, lambda x: contains(lower(content), x))) +
    0.8 * len(list_filter(l.terms, lambda x: contains(lower(coalesce(heading, '')), x))) +
    CASE WHEN contains(lower(l.title), l.q) OR contains(lower(l.document_number), l.q) THEN 1.0 ELSE 0 END, 6) AS pscore
  FROM live l JOIN x_provs p ON p.document_id = l.document_id"""),
          ("rk", """SELECT *, CASE WHEN document_nature = 'official_guidance' THEN 'guidance' ELSE 'rules' END AS lane, CAST(round(0.4 * doc_score + 0.6 * pscore, 6) AS DOUBLE) AS total_score FROM ps
  WHERE pscore > 0 AND status_override IS NULL AND (valid_from IS NULL OR valid_from <= as_of) AND (valid_to IS NULL OR as_of <= valid_to)
    AND provision_id NOT IN (SELECT provision_id FROM hits)"""),
          ("topk", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lane ORDER BY total_score DESC, provision_id) AS rank FROM rk) WHERE rank <= 10")]
_C17_ONE = with_views("SELECT query_id, lane, rank, provision_id, document_id, article, clause, total_score FROM topk WHERE query_id = 0", *_RULES)
_C17 = with_views("SELECT query_id, lane, rank, provision_id, document_id, article, clause, total_score FROM topk", *_RULES)


def k3_answerability(spark: SparkSession, sf: str) -> DataFrame:
    return search.answerability(_questions(spark), c17_effective_rules(spark, sf))


_K3 = with_views("""SELECT q.query_id, coalesce(r, 0) AS n_rules, coalesce(g, 0) AS n_guidance, coalesce(r + g, 0) > 0 AS answerable,
  CASE WHEN coalesce(r + g, 0) = 0 THEN 'INSUFFICIENT_EVIDENCE' END AS code FROM qs q LEFT JOIN (
  SELECT query_id, sum(CASE WHEN lane = 'rules' THEN 1 ELSE 0 END) AS r, sum(CASE WHEN lane = 'guidance' THEN 1 ELSE 0 END) AS g FROM topk GROUP BY query_id) t
  ON t.query_id = q.query_id""", *_RULES)


def c17_with_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Rules in force on two topics with their evidence, and whether sources agree about their documents."""
    evidence = verify.admissible(X.x_evid(spark, sf)).withColumn("provision_id", F.lit(None).cast("long"))
    return search.effective_rules(_questions(spark), X.x_docs(spark, sf), X.x_provs(spark, sf), X.x_rels(spark, sf), AS_OF, 10, evidence, ["vat", "invoice", "customs"],
                                  verify.verdicts(kept(X.x_asserts(spark, sf), "assertions")))


def k3_strict_answerability(spark: SparkSession, sf: str) -> DataFrame:
    return search.answerability(_questions(spark), c17_with_evidence(spark, sf), strict=True)


_TOPICAL = [*[(n, b.replace("WHERE document_nature NOT IN", "WHERE document_id % 7 IN (0, 2, 4) AND document_nature NOT IN")) for n, b in _RULES], _CONF, _PER, _AG, _VERD,
            ("answers", """SELECT t.query_id, lane, rank, t.provision_id, t.document_id, article, clause, total_score, substr(content, 1, CASE lane WHEN 'guidance' THEN 300 ELSE 250 END) AS snippet,
  coalesce(e.n, 0) AS n_evidence, coalesce(e.fields, '') AS fields, coalesce(v.status, 'unverified') AS verification,
  coalesce(v.high = 0 AND v.status IN ('cross_verified', 'single_source_verified'), FALSE) AND coalesce(e.n, 0) > 0 AS answerable FROM topk t LEFT JOIN verd v ON v.document_id = t.document_id
  LEFT JOIN (SELECT document_id, count(*) AS n, string_agg(DISTINCT field_name, ',' ORDER BY field_name) AS fields FROM x_evid WHERE NOT is_quarantined AND environment = 'production'
    AND evidence_origin <> 'synthetic_fixture' GROUP BY document_id) e ON e.document_id = t.document_id""")]
_C17_EVIDENCE = with_views("SELECT * FROM answers", *_TOPICAL)
_K3_STRICT = with_views("""SELECT q.query_id, coalesce(r, 0) AS n_rules, coalesce(g, 0) AS n_guidance, coalesce(ok, 0) > 0 AS answerable, CASE WHEN r IS NULL THEN 'INSUFFICIENT_EVIDENCE' WHEN ok > 0 THEN NULL
  WHEN bad > 0 THEN 'SOURCE_CONFLICT' WHEN said = 0 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'VERIFICATION_PENDING' END AS code FROM qs q LEFT JOIN (SELECT query_id, count(*) FILTER (lane = 'rules') AS r,
    count(*) FILTER (lane = 'guidance') AS g, count(*) FILTER (answerable) AS ok, count(*) FILTER (verification = 'conflicting') AS bad, count(*) FILTER (n_evidence > 0) AS said FROM answers GROUP BY query_id) a
  ON a.query_id = q.query_id""", *_TOPICAL)


def c14_latest_updates(spark: SparkSession, sf: str) -> DataFrame:
    return search.latest_updates(X.x_events(spark, sf), X.x_docs(spark, sf), "2024-01-20", 10, 100, ["issued", "amended", "repealed"])


_C14 = with_views("""SELECT event_id, e.document_id, event_type, event_date, document_number, title, document_nature, effective_from FROM x_events e JOIN x_docs d ON d.document_id = e.document_id
  WHERE event_date >= DATE '2024-01-10' AND event_type IN ('issued', 'amended', 'repealed') ORDER BY event_date DESC, event_id LIMIT 100""")


def p2_window(spark: SparkSession, sf: str) -> DataFrame:
    return search.window(X.x_events(spark, sf), "2024-01-25", 7, ["published"]).select("event_id", "document_id", "event_date")


_P2 = with_views("SELECT event_id, document_id, event_date FROM x_events WHERE event_date >= DATE '2024-01-18' AND event_type = 'published'")


def p1_filters(spark: SparkSession, sf: str) -> DataFrame:
    return search.filters(X.x_docs(spark, sf), types=["law", "decree"], issued_from="1997-01-01", issued_to="1999-06-30", issuer="build", effective_only=True,
                          topics=["vat", "invoice"]).select("document_id", "document_type", "issuer_name", "issued_date")


_P1 = with_views("""SELECT document_id, document_type, issuer_name, issued_date FROM x_docs WHERE document_nature NOT IN ('draft', 'proposal', 'consultation')
  AND document_type IN ('law', 'decree') AND issued_date BETWEEN DATE '1997-01-01' AND DATE '1999-06-30' AND issuer_name ILIKE '%build%' AND document_id % 7 IN (0, 2)""")


def j2_by_topic(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions import text as T
    d = X.x_docs(spark, sf)
    t = d.select("document_id", F.explode(T.topics(F.col("title"))).alias("topic"))
    return search.by_topic(d, t, ["customs", "accounting"]).select("document_id", "title")


_J2 = with_views("SELECT document_id, title FROM x_docs WHERE document_id % 7 IN (4, 5)")


def p3_resolve(spark: SparkSession, sf: str) -> DataFrame:
    d = X.x_docs(spark, sf).withColumn("canonical_id", F.concat(F.lit("VN:"), "document_number"))
    ids = d.select(F.when(F.col("document_id") % 2 == 0, F.col("document_id").cast("string")).otherwise(F.col("canonical_id")).alias("asked")).where("asked IS NOT NULL")
    return search.resolve(d, ids)


_P3 = with_views("SELECT CASE WHEN document_id % 2 = 0 THEN CAST(document_id AS VARCHAR) ELSE 'VN:' || document_number END AS asked, document_id FROM x_docs")


def j3_relationships(spark: SparkSession, sf: str) -> DataFrame:
    return search.relationships_of(X.x_docs(spark, sf).where("document_type = 'law'"), X.x_rels(spark, sf))


_J3 = with_views("""SELECT source_document_id AS document_id, relationship_id, 'outgoing' AS direction, target_document_id AS other_document_id, relationship_type FROM x_rels WHERE source_document_id % 6 = 0
  UNION ALL SELECT target_document_id, relationship_id, 'incoming', source_document_id, relationship_type FROM x_rels WHERE target_document_id % 6 = 0 AND source_document_id <> target_document_id""")


def c16_detail(spark: SparkSession, sf: str) -> DataFrame:
    return search.flat_detail(search.detail(X.x_docs(spark, sf), X.x_srcs(spark, sf), X.x_provs(spark, sf), X.x_rels(spark, sf), X.x_evid(spark, sf),
                                            verify.conflicts(kept(X.x_asserts(spark, sf), "assertions"))))


_N = lambda t: f"SELECT document_id, count(*) AS n FROM {t} GROUP BY document_id"
_C16 = with_views(f"""SELECT d.document_id, d.document_number, coalesce(s.n, 0) AS n_sources, coalesce(p.n, 0) AS n_provisions, coalesce(r.n, 0) AS n_relationships,
  coalesce(e.n, 0) AS n_evidence, coalesce(c.n, 0) AS n_conflicts, f.k AS first_sort_key FROM x_docs d LEFT JOIN ({_N('x_srcs')}) s ON s.document_id = d.document_id
  LEFT JOIN ({_N('x_provs')}) p ON p.document_id = d.document_id LEFT JOIN ({_N('x_evid')}) e ON e.document_id = d.document_id LEFT JOIN ({_N('conf')}) c ON c.document_id = d.document_id
  LEFT JOIN ({_N('ends')}) r ON r.document_id = d.document_id LEFT JOIN (SELECT document_id, min(sort_key) AS k FROM x_provs GROUP BY document_id) f ON f.document_id = d.document_id""",
                  _CONF, ("ends", "SELECT source_document_id AS document_id FROM x_rels UNION ALL SELECT target_document_id FROM x_rels WHERE source_document_id <> target_document_id"))


def c28_contract(spark: SparkSession, sf: str) -> DataFrame:
    docs, rels = X.x_docs(spark, sf), X.x_rels(spark, sf)
    evid = verify.admissible(X.x_evid(spark, sf))
    return search.contract(docs, status.documents_at(docs, rels, [AS_OF]), verify.verdicts(kept(X.x_asserts(spark, sf), "assertions")), evid)


_C28 = with_views("""SELECT document_id, as_of, status, b AS blockers, b = '' AS answerable FROM (
  SELECT s.document_id, s.as_of, s.status, concat_ws(',', CASE WHEN v.status = 'conflicting' THEN 'SOURCE_CONFLICT' END, CASE WHEN s.status = 'unknown' THEN 'UNKNOWN_STATUS' END,
    CASE WHEN s.effective_from IS NULL THEN 'MISSING_EFFECTIVE_DATE' END, CASE WHEN e.n IS NULL THEN 'NO_EVIDENCE' END,
    CASE WHEN coalesce(v.status, 'unverified') = 'unverified' THEN 'VERIFICATION_PENDING' END) AS b
  FROM state s LEFT JOIN verd v ON v.document_id = s.document_id LEFT JOIN (SELECT document_id, count(*) AS n FROM x_evid WHERE NOT is_quarantined AND environment = 'production'
    AND evidence_origin <> 'synthetic_fixture' GROUP BY document_id) e ON e.document_id = s.document_id)""", _ONE, _FLAGS, _STATE, _CONF, _PER, _AG, _VERD)

QUERIES = {f.__name__: f for f in (c15_search, c15_one_question, k5_indexed_search, k5_one_question, k5_question_a_document, c17_effective_rules, c17_one_question, k3_answerability, c17_with_evidence, k3_strict_answerability, c14_latest_updates, p2_window, p1_filters, j2_by_topic, p3_resolve, j3_relationships, c16_detail, c28_contract)}
ORACLE = {"c15_search": _C15, "c15_one_question": _C15_ONE, "k5_indexed_search": _C15, "k5_one_question": _C15_ONE, "k5_question_a_document": _K5_ALL, "c17_effective_rules": _C17, "c17_one_question": _C17_ONE, "k3_answerability": _K3, "c17_with_evidence": _C17_EVIDENCE, "k3_strict_answerability": _K3_STRICT, "c14_latest_updates": _C14, "p2_window": _P2, "p1_filters": _P1, "j2_by_topic": _J2,
          "p3_resolve": _P3, "j3_relationships": _J3, "c16_detail": _C16, "c28_contract": _C28}
