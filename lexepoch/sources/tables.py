"""Typed scans of the base tables and the derived views the point-in-time operators run on.

The base tables hold no legal text, so documents, provisions, relationships, sources, assertions, evidence and events
are derived from them by plain expressions. Each view exists twice: as a DataFrame here and as a common table
expression in ``SQL_VIEWS`` for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of one table with its fixed schema: columns and filters reach the Parquet reader."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def pick(index: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


TYPES = ["law", "decree", "circular", "decision", "official_letter", "other"]
LABELS = ["Luật", "Nghị định", "Thông tư", "Quyết định", "Công văn", "Thông báo"]
BODIES = ["Chính phủ", "Bộ Tài chính", "Tổng cục Thuế", "Quốc hội", "Thủ tướng"]
SUBJECTS = ["thuế giá trị gia tăng", "thuế thu nhập doanh nghiệp", "hóa đơn", "quản lý thuế", "hải quan", "kế toán", "phí"]
EDGE_TYPES = ["repeals", "replaces", "suspends", "partially_repeals", "amends"]
AUTHORITIES = ["tier_a", "tier_b", "tier_c", "news"]


def x_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    key, issued = F.col("o_orderkey"), F.to_date("o_orderdate")
    number = F.concat(key.cast("string"), F.lit("/"), F.year(issued).cast("string"), F.lit("/NĐ-CP"))
    nature = (F.when(F.substring("o_orderpriority", 1, 1).isin("1", "2"), "normative_legal_document")
              .when(F.substring("o_orderpriority", 1, 1) == "3", "official_guidance")
              .when(F.substring("o_orderpriority", 1, 1) == "4", "administrative_document").otherwise("draft"))
    title = F.concat(pick(key % 6, LABELS), F.lit(" số "), number, F.lit(" của "), pick(key % 5, BODIES), F.lit(" về "), pick(key % 7, SUBJECTS))
    status = F.when(F.col("o_orderstatus") == "F", "cross_verified").when(F.col("o_orderstatus") == "O", "single_source_verified").otherwise("unverified")
    return o.join(c, o.o_custkey == c.c_custkey, "left").select(
        key.alias("document_id"), number.alias("document_number"), pick(key % 6, TYPES).alias("document_type"),
        nature.alias("document_nature"), title.alias("title"), F.col("c_mktsegment").alias("issuer_name"), issued.alias("issued_date"),
        F.when(key % 13 != 0, F.date_add(issued, 45)).alias("effective_from"),
        F.when(key % 4 == 0, F.date_add(issued, 765)).alias("effective_to"), status.alias("verification_status"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (load(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.to_date(F.min("l_shipdate")).alias("ship"), F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"),
        F.max(((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).cast("int")).alias("edge")))


def x_provs(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, p = _lines(spark, sf_dir), load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    clause = F.when(F.col("supp") % 3 != 0, (F.col("supp") % 3).cast("string"))
    return g.join(p, g.part == p.p_partkey, "left").select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("provision_id"), F.col("l_orderkey").alias("document_id"),
        F.concat(F.lit("Điều "), F.col("l_linenumber").cast("string")).alias("article"), clause.alias("clause"),
        F.when(F.col("part") % 5 == 0, F.col("ship")).alias("valid_from"),
        F.when(F.col("part") % 7 == 0, F.date_add("ship", 365)).alias("valid_to"),
        F.when(F.col("part") % 11 == 0, F.lit("repealed")).alias("status_override"), F.col("p_name").alias("content"),
        F.when(F.col("part") % 4 == 0, F.lit("Small ring")).when(F.col("part") % 4 == 1, F.col("p_type")).alias("heading"),
        F.concat(F.lpad(F.col("l_linenumber").cast("string"), 4, "0"), F.lit(".0000")).alias("sort_key"))


def x_rels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "orders").count()
    g = _lines(spark, sf_dir).where("edge = 1")
    return g.select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("relationship_id"), F.col("l_orderkey").alias("source_document_id"),
        ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % F.lit(max(n, 1))).alias("target_document_id"),
        pick(F.col("part") % 5, EDGE_TYPES).alias("relationship_type"), F.col("ship").alias("effective_from"),
        F.when(F.col("supp") % 2 == 0, F.date_add("ship", 400)).alias("effective_to"),
        F.concat(F.lit("Điều "), F.col("l_linenumber").cast("string")).alias("target_article"),
        F.when(F.col("supp") % 3 != 0, (F.col("supp") % 3).cast("string")).alias("target_clause"))


def x_srcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (load(spark, sf_dir, "lineitem").where("l_linenumber <= 2").select(
        F.col("l_orderkey").alias("document_id"), F.col("l_suppkey").alias("source_id")).distinct()
        .withColumn("source_authority", pick(F.col("source_id") % 4, AUTHORITIES)))


def x_asserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, d = x_srcs(spark, sf_dir), x_docs(spark, sf_dir)
    return s.join(d, "document_id").select(
        "document_id", "source_id", "source_authority", "document_number",
        F.when(F.col("source_id") % 17 == 0, F.date_add("issued_date", 1)).otherwise(F.col("issued_date")).alias("issued_date"),
        F.when(F.col("source_id") % 10 == 0, F.date_add("effective_from", 14)).otherwise(F.col("effective_from")).alias("effective_from"),
        "effective_to")


EVIDENCE_FIELDS = ["document_number", "issued_date", "effective_from", "effective_to"]


def x_evid(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = x_asserts(spark, sf_dir)
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("asserted_value")) for f in EVIDENCE_FIELDS])
    sid = F.col("source_id")
    return (a.select("document_id", F.col("source_id").alias("snapshot_id"), "source_id", F.explode(pairs).alias("e"))
            .select("document_id", "snapshot_id", "source_id", "e.field_name", "e.asserted_value").where("asserted_value IS NOT NULL")
            .withColumn("is_quarantined", sid % 19 == 0)
            .withColumn("environment", F.when(sid % 23 == 0, "test").otherwise("production"))
            .withColumn("evidence_origin", F.when(sid % 29 == 0, "synthetic_fixture").when(sid % 2 == 0, "live_official").otherwise("imported_official")))


EVENT_TYPES = {"view": "published", "signup": "issued", "purchase": "became_effective", "click": "amended", "error": "repealed"}


def x_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "orders").count()
    kind = F.col("event_type")
    named = F.coalesce(*[F.when(kind == k, v) for k, v in EVENT_TYPES.items()])
    return load(spark, sf_dir, "events").select(
        "event_id", (F.col("event_id") % F.lit(max(n, 1))).alias("document_id"), named.alias("event_type"),
        F.to_date("ts").alias("event_date"), "ts", "user_id")


def x_snaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of every document's page: the second differs where doc_id is divisible by 10."""
    d = load(spark, sf_dir, "documents")
    first = d.select(F.col("doc_id").alias("source_id"), F.lit(1).alias("version"), "text", F.col("doc_id").alias("snapshot_id"))
    second = d.select(F.col("doc_id").alias("source_id"), F.lit(2).alias("version"),
                      F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" (sửa đổi)"))).otherwise(F.col("text")).alias("text"),
                      (F.col("doc_id") + 1_000_000_000).alias("snapshot_id"))
    return first.unionByName(second)


def _case(index: str, values: list[str]) -> str:
    return "CASE " + index + " " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_LINES = """SELECT l_orderkey, l_linenumber, CAST(min(l_shipdate) AS DATE) AS ship, min(l_partkey) AS part, min(l_suppkey) AS supp,
  max(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 1 ELSE 0 END) AS edge FROM lineitem GROUP BY l_orderkey, l_linenumber"""
_CLAUSE = "CASE WHEN supp % 3 <> 0 THEN CAST(supp % 3 AS VARCHAR) END"

#: Common table expressions in an order in which each uses only those before it.
SQL_VIEWS = {
    "x_docs": f"""SELECT o_orderkey AS document_id, o_orderkey || '/' || year(CAST(o_orderdate AS DATE)) || '/NĐ-CP' AS document_number,
  {_case('o_orderkey % 6', TYPES)} AS document_type,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'normative_legal_document' WHEN '2' THEN 'normative_legal_document'
    WHEN '3' THEN 'official_guidance' WHEN '4' THEN 'administrative_document' ELSE 'draft' END AS document_nature,
  {_case('o_orderkey % 6', LABELS)} || ' số ' || o_orderkey || '/' || year(CAST(o_orderdate AS DATE)) || '/NĐ-CP của ' ||
    {_case('o_orderkey % 5', BODIES)} || ' về ' || {_case('o_orderkey % 7', SUBJECTS)} AS title,
  c_mktsegment AS issuer_name, CAST(o_orderdate AS DATE) AS issued_date,
  CASE WHEN o_orderkey % 13 <> 0 THEN CAST(CAST(o_orderdate AS DATE) + 45 AS DATE) END AS effective_from,
  CASE WHEN o_orderkey % 4 = 0 THEN CAST(CAST(o_orderdate AS DATE) + 765 AS DATE) END AS effective_to,
  CASE o_orderstatus WHEN 'F' THEN 'cross_verified' WHEN 'O' THEN 'single_source_verified' ELSE 'unverified' END AS verification_status
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "x_lines": _LINES,
    "x_provs": f"""SELECT l_orderkey * 100 + l_linenumber AS provision_id, l_orderkey AS document_id, 'Điều ' || l_linenumber AS article,
  {_CLAUSE} AS clause, CASE WHEN part % 5 = 0 THEN ship END AS valid_from,
  CASE WHEN part % 7 = 0 THEN CAST(ship + 365 AS DATE) END AS valid_to, CASE WHEN part % 11 = 0 THEN 'repealed' END AS status_override,
  p_name AS content, CASE part % 4 WHEN 0 THEN 'Small ring' WHEN 1 THEN p_type END AS heading, lpad(CAST(l_linenumber AS VARCHAR), 4, '0') || '.0000' AS sort_key FROM x_lines LEFT JOIN part ON part = p_partkey""",
    "x_rels": f"""SELECT l_orderkey * 100 + l_linenumber AS relationship_id, l_orderkey AS source_document_id,
  (l_orderkey * 7 + l_linenumber) % (SELECT count(*) FROM orders) AS target_document_id, {_case('part % 5', EDGE_TYPES)} AS relationship_type,
  ship AS effective_from, CASE WHEN supp % 2 = 0 THEN CAST(ship + 400 AS DATE) END AS effective_to,
  'Điều ' || l_linenumber AS target_article, {_CLAUSE} AS target_clause FROM x_lines WHERE edge = 1""",
    "x_srcs": f"""SELECT DISTINCT l_orderkey AS document_id, l_suppkey AS source_id, {_case('l_suppkey % 4', AUTHORITIES)} AS source_authority
  FROM lineitem WHERE l_linenumber <= 2""",
    "x_asserts": """SELECT s.document_id, s.source_id, s.source_authority, d.document_number,
  CASE WHEN s.source_id % 17 = 0 THEN CAST(d.issued_date + 1 AS DATE) ELSE d.issued_date END AS issued_date,
  CASE WHEN s.source_id % 10 = 0 THEN CAST(d.effective_from + 14 AS DATE) ELSE d.effective_from END AS effective_from, d.effective_to
  FROM x_srcs s JOIN x_docs d ON s.document_id = d.document_id""",
    "x_evid0": " UNION ALL ".join(
        f"SELECT document_id, source_id, '{f}' AS field_name, CAST({f} AS VARCHAR) AS asserted_value FROM x_asserts" for f in EVIDENCE_FIELDS),
    "x_evid": """SELECT document_id, source_id AS snapshot_id, source_id, field_name, asserted_value, source_id % 19 = 0 AS is_quarantined,
  CASE WHEN source_id % 23 = 0 THEN 'test' ELSE 'production' END AS environment,
  CASE WHEN source_id % 29 = 0 THEN 'synthetic_fixture' WHEN source_id % 2 = 0 THEN 'live_official' ELSE 'imported_official' END AS evidence_origin
  FROM x_evid0 WHERE asserted_value IS NOT NULL""",
    "x_events": "SELECT event_id, event_id % (SELECT count(*) FROM orders) AS document_id, CASE event_type "
                + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_TYPES.items())
                + " END AS event_type, CAST(ts AS DATE) AS event_date, ts, user_id FROM events",
    "x_snaps": """SELECT doc_id AS source_id, 1 AS version, text, doc_id AS snapshot_id FROM documents UNION ALL
  SELECT doc_id, 2, CASE WHEN doc_id % 10 = 0 THEN text || ' (sửa đổi)' ELSE text END, doc_id + 1000000000 FROM documents""",
}
_NEEDS = {"x_provs": ["x_lines"], "x_rels": ["x_lines"], "x_asserts": ["x_docs", "x_srcs"], "x_evid0": ["x_asserts"], "x_evid": ["x_evid0"]}


def with_views(sql: str, *extra: tuple[str, str]) -> str:
    """sql with the views it names in front, and further (name, body) expressions after them."""
    text = sql + " ".join(body for _, body in extra)
    wanted = {v for v in SQL_VIEWS if v in text.replace(v + "0", "")} | {v for v in SQL_VIEWS if v in text}
    while more := {n for w in wanted for n in _NEEDS.get(w, [])} - wanted:
        wanted |= more
    parts = [f"{n} AS ({SQL_VIEWS[n]})" for n in SQL_VIEWS if n in wanted] + [f"{n} AS ({b})" for n, b in extra]
    return "WITH " + ", ".join(parts) + " " + sql
