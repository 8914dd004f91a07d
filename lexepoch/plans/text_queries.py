"""Queries on texts, identities and snapshots."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import canonical, segment, snapshots
from ..sources import sinks, tables as X
from ..sources.scratch import new_path
from ..sources.tables import with_views

_DMY = "day(issued_date) || '/' || month(issued_date) || '/' || year(issued_date)"


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a text that states number, issue date and start of effect."""
    d = X.x_docs(spark, sf)
    long = lambda c: F.concat(F.lit("ngày "), F.dayofmonth(c).cast("string"), F.lit(" tháng "), F.month(c).cast("string"), F.lit(" năm "), F.year(c).cast("string"))
    text = F.concat(F.lit("Số: "), "document_number", F.lit("\nHà Nội, "), long(F.col("issued_date")),
                    F.coalesce(F.concat(F.lit("\nVăn bản này có hiệu lực kể từ "), long(F.col("effective_from"))), F.lit("")), F.lit("\nĐiều khoản thi hành."))
    return d.withColumn("text", text)


def f11_metadata(spark: SparkSession, sf: str) -> DataFrame:
    t = _texts(spark, sf).select("document_id", T.metadata(F.col("title"), F.col("text")).alias("m"))
    return t.select("document_id", "m.document_number", "m.document_type", "m.document_nature", "m.issuer_name", "m.issued_date", "m.effective_from",
                    F.array_join("m.topics", ",").alias("topics"))


def _cases(index: str, values: list[str]) -> str:
    return "CASE " + index + " " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


_F11 = with_views("""SELECT document_id, document_number, """ + _cases("document_id % 6", ["'law'", "'decree'", "'circular'", "'decision'", "'official_letter'", "'announcement'"]) + """ AS document_type,
  """ + _cases("document_id % 6", ["'normative_legal_document'"] * 3 + ["'administrative_document'", "'official_guidance'", "'administrative_document'"]) + """ AS document_nature,
  """ + _cases("document_id % 5", ["'Chính phủ'", "'Bộ Tài chính'", "'Tổng cục Thuế'", "'Quốc hội'", "'Thủ tướng Chính phủ'"]) + """ AS issuer_name,
  issued_date, effective_from, """ + _cases("document_id % 7", ["'vat'", "'cit'", "'invoice'", "'tax_administration'", "'import_export_duty,customs'", "'accounting'", "'other'"]) + """ AS topics
  FROM x_docs""")


def f2_dates(spark: SparkSession, sf: str) -> DataFrame:
    d = X.x_docs(spark, sf)
    i = F.col("issued_date")
    short = F.concat_ws("/", F.dayofmonth(i).cast("string"), F.month(i).cast("string"), F.year(i).cast("string"))
    return d.select("document_id", T.vn_date(F.concat(F.lit("Ban hành ngày "), short)).alias("short"), T.normalize_date(short).alias("dmy"),
                    T.normalize_date(F.concat(i.cast("string"), F.lit("T08:00:00"))).alias("iso"), T.vn_date(F.lit("ngày 31/02/2020")).alias("impossible"))


_F2 = with_views("SELECT document_id, issued_date AS short, issued_date AS dmy, issued_date AS iso, CAST(NULL AS DATE) AS impossible FROM x_docs")


def f12_identities(spark: SparkSession, sf: str) -> DataFrame:
    d = X.x_docs(spark, sf)
    number = F.when(F.col("document_id") % 9 == 0, F.lit(None)).otherwise(F.concat(F.lower("document_number"), F.lit(" .")))
    return d.select("document_id", T.normalize_number(number).alias("number"),
                    T.canonical_id(F.col("document_type"), number, F.col("issued_date"), F.col("title")).alias("canonical_id"),
                    T.title_fingerprint(F.col("title")).alias("title_fp"), T.extract_year(F.col("document_number"), F.lit(None).cast("date"), F.lit(None).cast("date")).alias("year"),
                    T.corpus_issuer(F.lit(None).cast("string"), F.lit(""), F.col("document_number")).alias("issuer"))


_CODE = "CASE document_type WHEN 'law' THEN 'LUAT' WHEN 'decree' THEN 'ND' WHEN 'circular' THEN 'TT' WHEN 'decision' THEN 'QD' WHEN 'official_letter' THEN 'CV' ELSE 'VB' END"
_F12 = with_views(f"""SELECT document_id, CASE WHEN document_id % 9 <> 0 THEN document_id || '/' || year(issued_date) || '/ND-CP' END AS number,
  CASE WHEN document_id % 9 = 0 THEN 'VN:UNRESOLVED:' || sha256(title) ELSE 'VN:' || {_CODE} || ':' || year(issued_date) || ':' || document_id || '-' || year(issued_date) || '-ND-CP' END AS canonical_id,
  trim(regexp_replace(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS title_fp, CAST(year(issued_date) AS VARCHAR) AS year,
  'Chính phủ' AS issuer FROM x_docs""")


def f16_hashes(spark: SparkSession, sf: str) -> DataFrame:
    d = X.load(spark, sf, "documents")
    return d.select("doc_id", T.sha256(F.col("text")).alias("text_hash"), T.sha256(T.normalized_text(F.col("text"))).alias("normalized_hash"))


_F16 = r"""SELECT doc_id, sha256(text) AS text_hash, sha256(trim(regexp_replace(lower(text), '[\s\p{Z}]+', ' ', 'g'))) AS normalized_hash FROM documents"""


def f19_page_text(spark: SparkSession, sf: str) -> DataFrame:
    return X.load(spark, sf, "pages").select("page_id", F.sha2(T.strip_tags(F.col("html")), 256).alias("text_hash"), F.length(T.strip_tags(F.col("html"))).alias("n"))


_STRIP = r"""regexp_replace(html, '<[^>]*>', ' ', 'g')"""
for _a, _b in (("&quot;", '"'), ("&apos;", "''"), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")):
    _STRIP = f"replace({_STRIP}, '{_a}', '{_b}')"
_STRIP = rf"trim(regexp_replace({_STRIP}, '[\s\p{{Z}}]+', ' ', 'g'))"
_F19 = f"SELECT page_id, sha256({_STRIP}) AS text_hash, length({_STRIP}) AS n FROM pages"


def f1_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """Numeric entities made from the pages' titles decode to those titles; texts in NFD compose to NFC."""
    d = X.load(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<h1>(.*?)</h1>", 1).alias("t"))
    coded = F.concat(F.lit("&#"), F.ascii("t").cast("string"), F.lit(";"), F.expr("substring(t, 2)"))
    return d.where("t <> ''").select("page_id", T.nfc(T.decode_entities(coded)).alias("decoded"))


_TITLE = r"regexp_extract(html, '<h1>(.*?)</h1>', 1)"
_NAMED = _TITLE
for _a, _b in (("&quot;", '"'), ("&apos;", "''"), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")):
    _NAMED = f"replace({_NAMED}, '{_a}', '{_b}')"
_F1 = f"SELECT page_id, nfc_normalize({_NAMED}) AS decoded FROM pages WHERE {_TITLE} <> ''"


def f20_tokens(spark: SparkSession, sf: str) -> DataFrame:
    d = X.load(spark, sf, "documents")
    return d.select("doc_id", F.size(T.query_terms(F.col("text"))).alias("n_terms"), F.size(T.tokens(F.col("text"))).alias("n_tokens"))


_F20 = r"""SELECT doc_id, len(list_filter(regexp_split_to_array(trim(regexp_replace(lower(text), '[^\p{L}\p{N}\s]', ' ', 'g')), '\s+'), lambda x: length(x) > 1)) AS n_terms,
  len(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> ''))) AS n_tokens FROM documents"""


def u3_topics(spark: SparkSession, sf: str) -> DataFrame:
    rules = [("law_of_the", ("the", "law")), ("der", ("der ", "und")), ("license", ("license",)), ("mail", ("@",))]
    d = X.load(spark, sf, "documents")
    return d.select("doc_id", F.explode(T.topics(F.col("text"), rules)).alias("topic"))


_U3 = """SELECT doc_id, topic FROM (SELECT doc_id, 'law_of_the' AS topic FROM documents WHERE contains(lower(text), 'the') OR contains(lower(text), 'law')
  UNION ALL SELECT doc_id, 'der' FROM documents WHERE contains(lower(text), 'der ') OR contains(lower(text), 'und')
  UNION ALL SELECT doc_id, 'license' FROM documents WHERE contains(lower(text), 'license') UNION ALL SELECT doc_id, 'mail' FROM documents WHERE contains(lower(text), '@'))
  UNION ALL SELECT doc_id, 'other' FROM documents WHERE NOT (contains(lower(text), 'the') OR contains(lower(text), 'law') OR contains(lower(text), 'der ')
    OR contains(lower(text), 'und') OR contains(lower(text), 'license') OR contains(lower(text), '@'))"""


def f5_natures(spark: SparkSession, sf: str) -> DataFrame:
    """Titles and texts that say every nature: the first rule that holds decides."""
    d = X.x_docs(spark, sf)
    title = F.concat(X.pick(F.col("document_id") % 8, _OPENINGS), "title")
    return d.select("document_id", T.document_nature(title, F.col("document_type"), F.when(F.col("document_id") % 8 == 7, F.lit("Kính gửi. HƯỚNG DẪN thực hiện")).otherwise(F.lit(""))).alias("nature"))


_OPENINGS = ["Lấy ý kiến về dự thảo ", "Dự thảo ", "Tờ trình về ", "Văn bản hợp nhất ", "Đính chính ", "Ban hành quy chế của ", "", ""]
_F5 = with_views("""SELECT document_id, CASE document_id % 8 WHEN 0 THEN 'consultation' WHEN 1 THEN 'draft' WHEN 2 THEN 'proposal' WHEN 3 THEN 'consolidated_document' WHEN 4 THEN 'correction'
  ELSE CASE WHEN document_type IN ('law', 'decree', 'circular') THEN 'normative_legal_document' WHEN document_type = 'official_letter' OR document_id % 8 = 7 THEN 'official_guidance'
    WHEN document_type = 'decision' THEN CASE WHEN document_id % 8 = 5 THEN 'normative_legal_document' ELSE 'administrative_document' END ELSE 'other' END END AS nature FROM x_docs""")


def f6_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Each of the fourteen topics in turn, by one of its words."""
    d = X.x_docs(spark, sf)
    words = X.pick(F.col("document_id") % len(T.TOPIC_RULES), [w[-1] for _, w in T.TOPIC_RULES])
    return d.select("document_id", F.array_join(T.topics(F.concat(F.lit("Về việc "), F.upper(words))), ",").alias("topics"))


_F6 = with_views("SELECT document_id, " + _cases(f"document_id % {len(T.TOPIC_RULES)}", [
    "'import_export_duty,customs'" if name in ("import_export_duty", "customs") else f"'{name}'" for name, _ in T.TOPIC_RULES]) + " AS topics FROM x_docs")


def f10_issuers(spark: SparkSession, sf: str) -> DataFrame:
    """Issuers by what is given, by the title, by the number's ending, and the other body."""
    d, i = X.x_docs(spark, sf), F.col("document_id")
    number = F.concat(i.cast("string"), F.lit("/2019"), X.pick(i % 7, ["/NĐ-CP", "/QĐ-TTg", "/TT-BTC", "/QH14", "/TT-NHNN", "/TCT-CS", "/VB"]))
    given = F.when(i % 3 == 0, F.lit("  ")).when(i % 11 == 1, F.col("issuer_name"))
    title = F.when(i % 5 == 4, F.lit("Thông tư của Bộ Tài chính")).otherwise(F.lit("Văn bản"))
    return d.select("document_id", T.corpus_issuer(given, title, number).alias("issuer"))


_BY_NUMBER = _cases("document_id % 7", ["'Chính phủ'", "'Thủ tướng Chính phủ'", "'Bộ Tài chính'", "'Quốc hội'", "'Ngân hàng Nhà nước'", "'Tổng cục Thuế'", "'Cơ quan ban hành khác'"])
_F10 = with_views(f"""SELECT document_id, CASE WHEN document_id % 3 <> 0 AND document_id % 11 = 1 AND issuer_name IS NOT NULL THEN issuer_name
  WHEN document_id % 5 = 4 AND document_id % 7 NOT IN (0, 1) THEN 'Bộ Tài chính' ELSE {_BY_NUMBER} END AS issuer FROM x_docs""")


def f17_object_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Hash of each document's fields, given in another order than that of their names."""
    d = X.x_docs(spark, sf)
    return d.select("document_id", T.object_hash(F.create_map(F.lit("title"), "title", F.lit("number"), "document_number", F.lit("nature"), "document_nature")).alias("object_hash"))


_F17 = with_views("""SELECT document_id, sha256('{"nature":"' || document_nature || '","number":"' || document_number || '","title":"' || title || '"}') AS object_hash FROM x_docs""")


def f18_years(spark: SparkSession, sf: str) -> DataFrame:
    """Years by issue date, by publication, by either form of number, and none."""
    d, i = X.x_docs(spark, sf), F.col("document_id")
    number = F.when(i % 5 == 2, F.concat(i.cast("string"), F.lit("/1987/QH"))).when(i % 5 == 3, F.lit("CV-1990-7")).when(i % 5 == 4, F.lit("12/QĐ"))
    return d.select("document_id", T.extract_year(number, F.when(i % 5 == 0, F.col("issued_date")), F.when(i % 5 == 1, F.col("effective_from"))).alias("year"))


_F18 = with_views("""SELECT document_id, CASE document_id % 5 WHEN 0 THEN coalesce(CAST(year(issued_date) AS VARCHAR), 'UNKNOWN') WHEN 1 THEN coalesce(CAST(year(effective_from) AS VARCHAR), 'UNKNOWN')
  WHEN 2 THEN '1987' WHEN 3 THEN '1990' ELSE 'UNKNOWN' END AS year FROM x_docs""")


def f26_local_dates(spark: SparkSession, sf: str) -> DataFrame:
    """The legal date of every event's moment, which is the day after in UTC's last seven hours."""
    return X.load(spark, sf, "events").select("event_id", T.local_today(F.col("ts").cast("timestamp")).alias("local_date"))


_F26 = "SELECT event_id, CAST(ts + INTERVAL 7 HOUR AS DATE) AS local_date FROM events"


# -- segmentation and relationships: texts composed from the views, parsed back ---------------------------------------
def _articles(spark: SparkSession, sf: str) -> DataFrame:
    """One text per document: an article heading per provision, a clause line where the provision has a clause."""
    p = X.x_provs(spark, sf)
    block = F.concat(F.lit("Điều "), (F.col("provision_id") % 100).cast("string"), F.lit(". "), "content",
                     F.coalesce(F.concat(F.lit("\n"), "clause", F.lit(". "), "content"), F.lit("")))
    return p.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("provision_id", block.alias("b")))).alias("x")).select(
        "document_id", F.concat(F.lit("Mở đầu\nChương I\n"), F.array_join(F.transform("x", lambda e: e["b"]), "\n")).alias("text"))


def c1_segment(spark: SparkSession, sf: str) -> DataFrame:
    return segment.provisions(_articles(spark, sf)).select("document_id", "chapter", "article", "clause", "heading", "content", "sort_key", "content_hash")


_C1 = with_views("""SELECT document_id, 'Chương I' AS chapter, article, c AS clause, content AS heading, body AS content,
  lpad(CAST(n AS VARCHAR), 4, '0') || '.' || k AS sort_key, sha256(body) AS content_hash FROM (
  SELECT document_id, article, n, content, CAST(NULL AS VARCHAR) AS c, article || '. ' || content AS body, CASE WHEN clause IS NULL THEN '0000' ELSE '0001' END AS k FROM a
  UNION ALL SELECT document_id, article, n, content, clause, clause || '. ' || content, '0002' FROM a WHERE clause IS NOT NULL)""",
                 ("a", "SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY provision_id) AS n FROM x_provs"))

_VERBS = {"repeals": "Bãi bỏ Nghị định số ", "replaces": "Thay thế Nghị định số ", "amends": "Sửa đổi, bổ sung một số điều của Nghị định số "}


#: Letters of the views' words that have a decomposed form, and that form.
_WHOLE = sorted({c for w in (*X.LABELS, *X.BODIES, *X.SUBJECTS, "Điều Khoản Mục Chương Mở đầu") for c in w if unicodedata.normalize("NFD", c) != c})


def _decomposed(c: Column) -> Column:
    for letter in _WHOLE:
        c = F.replace(c, F.lit(letter), F.lit(unicodedata.normalize("NFD", letter)))
    return c


def c1_decomposed(spark: SparkSession, sf: str) -> DataFrame:
    """Texts in decomposed letters: the same headings are found, and what is cut out is composed."""
    return segment.provisions(_articles(spark, sf).withColumn("text", _decomposed(F.col("text")))).select(
        "document_id", "chapter", "article", "clause", "heading", "content", "sort_key", "content_hash")


def f16_decomposed(spark: SparkSession, sf: str) -> DataFrame:
    """Titles in decomposed letters have the fingerprint, the hash and the number of the composed ones."""
    d = X.x_docs(spark, sf).withColumn("title", _decomposed(F.col("title")))
    return d.select("document_id", T.title_fingerprint(F.col("title")).alias("title_fp"), T.sha256(T.normalized_text(F.col("title"))).alias("normalized_hash"),
                    T.normalize_number(F.col("title")).alias("number"))


_F16_DECOMPOSED = with_views(r"""SELECT document_id, trim(regexp_replace(regexp_replace(lower(nfc_normalize(title)), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g')) AS title_fp,
  sha256(trim(regexp_replace(lower(nfc_normalize(title)), '\s+', ' ', 'g'))) AS normalized_hash, regexp_replace(replace(upper(strip_accents(title)), 'Đ', 'D'), '\s+', '', 'g') AS number FROM x_docs""".replace(chr(92) * 2, chr(92)))


def f19_encoded_text(spark: SparkSession, sf: str) -> DataFrame:
    """Pages whose letters e and n outside of tags are numeric references, one of them hexadecimal: the same text comes out."""
    body = F.regexp_replace(F.regexp_replace("html", r"(?<=>)([^<>&]*?)e", "$1&#101;"), r"(?<=>)([^<>&#]*?)n", "$1&#x6E;")
    return X.load(spark, sf, "pages").withColumn("html", body).select("page_id", F.sha2(T.strip_tags(F.col("html")), 256).alias("text_hash"), F.length(T.strip_tags(F.col("html"))).alias("n"))


def c2_relationships(spark: SparkSession, sf: str) -> DataFrame:
    r = X.x_rels(spark, sf)
    number = F.concat(F.col("target_document_id").cast("string"), F.lit("/2020/NĐ-CP"))
    kind = F.col("relationship_type")
    part = F.concat(F.lit("Bãi bỏ "), F.coalesce(F.concat(F.lit("Khoản "), "target_clause", F.lit(" ")), F.lit("")), "target_article", F.lit(" Nghị định số "), number)
    line = (F.when(kind == "partially_repeals", part).when(kind == "suspends", F.concat(F.lit("Tạm ngưng "), number))
            .otherwise(F.concat(F.coalesce(*[F.when(kind == k, v) for k, v in _VERBS.items()]), number)))
    docs = r.groupBy(F.col("source_document_id").alias("document_id")).agg(F.array_sort(F.collect_list(F.struct("relationship_id", line.alias("l")))).alias("x")).select(
        "document_id", F.array_join(F.transform("x", lambda e: e["l"]), "\n").alias("text"))
    return segment.relationships(docs).select("document_id", "line_no", "relationship_type", "target_number", "target_article", "target_clause")


_C2 = with_views("""SELECT document_id, line_no, relationship_type, target_document_id || '/2020/ND-CP' AS target_number,
  CASE WHEN relationship_type = 'partially_repeals' THEN target_article END AS target_article,
  CASE WHEN relationship_type = 'partially_repeals' THEN target_clause END AS target_clause FROM l WHERE relationship_type <> 'suspends'""",
                 ("l", "SELECT *, source_document_id AS document_id, row_number() OVER (PARTITION BY source_document_id ORDER BY relationship_id) - 1 AS line_no FROM x_rels"))


def c2_all_targets(spark: SparkSession, sf: str) -> DataFrame:
    """One line a document that repeals the first target, clauses of the second, amends the third and repeals all others."""
    r = X.x_rels(spark, sf)
    numbered = r.groupBy(F.col("source_document_id").alias("document_id")).agg(F.array_sort(F.collect_list(F.struct("relationship_id", "target_document_id"))).alias("all"))
    law = lambda e: F.concat(F.lit("Nghị định số "), e["target_document_id"].cast("string"), F.lit("/2020/NĐ-CP"))
    part = lambda e, i: (F.when(i == 0, F.concat(F.lit("Bãi bỏ "), law(e))).when(i == 1, F.concat(F.lit(", khoản 2 Điều 5 của "), law(e)))
                         .when(i == 2, F.concat(F.lit("; sửa đổi một số điều của "), law(e), F.lit(" ngày 3 tháng 4 năm 2020; bãi bỏ các quyết định trước")))
                         .otherwise(F.concat(F.when(i == 3, F.lit("; thay thế ")).otherwise(F.lit(" và ")), law(e))))
    docs = numbered.select("document_id", F.array_join(F.transform("all", part), "").alias("text"))
    return segment.relationships(docs).select("document_id", "line_no", "relationship_type", "target_number", "target_article", "target_clause")


_C2_ALL = with_views("""SELECT document_id, 0 AS line_no, CASE n WHEN 0 THEN 'repeals' WHEN 1 THEN 'partially_repeals' WHEN 2 THEN 'amends' ELSE 'replaces' END AS relationship_type,
  target_document_id || '/2020/ND-CP' AS target_number, CASE WHEN n = 1 THEN 'Điều 5' END AS target_article, CASE WHEN n = 1 THEN '2' END AS target_clause FROM (
  SELECT source_document_id AS document_id, target_document_id, row_number() OVER (PARTITION BY source_document_id ORDER BY relationship_id) - 1 AS n FROM x_rels)""")


def j12_resolved_edges(spark: SparkSession, sf: str) -> DataFrame:
    r, d = X.x_rels(spark, sf), X.x_docs(spark, sf)
    named = r.join(d.select(F.col("document_id").alias("target_document_id"), "document_number"), "target_document_id").select(
        F.col("source_document_id").alias("document_id"), "relationship_id",
        T.normalize_number(F.when(F.col("relationship_id") % 4 == 0, F.lit("9/1900/QH")).otherwise(F.col("document_number"))).alias("target_number"))
    return segment.resolve(named, d).select("relationship_id", "document_id", "target_document_id", "effective_from")


_J12 = with_views("""SELECT relationship_id, source_document_id AS document_id, CASE WHEN relationship_id % 4 <> 0 THEN target_document_id END AS target_document_id, d.effective_from
  FROM x_rels r JOIN x_docs t ON t.document_id = r.target_document_id LEFT JOIN x_docs d ON d.document_id = r.source_document_id""")


# -- identity ---------------------------------------------------------------------------------------------------------
def c5_dedupe_match(spark: SparkSession, sf: str) -> DataFrame:
    """Each document against those with smaller ids: by a made-up number, its date, its text, its first line."""
    d = X.load(spark, sf, "documents")
    base = d.select("doc_id", F.concat(F.col("source"), F.lit("/"), (F.col("n_chars") % 50).cast("string")).alias("document_number"),
                    (F.col("doc_id") % 7).cast("string").alias("issued_date"), F.sha2("text", 256).alias("text_hash"),
                    F.nullif(T.title_fingerprint(F.substring_index("text", "\n", 1)), F.lit("")).alias("title_fp"))
    return canonical.match(base.withColumnRenamed("doc_id", "candidate_id"), base.withColumnRenamed("doc_id", "document_id"), earlier=True).withColumn("signals", F.array_join("signals", ","))


_C5 = r"""WITH b AS (SELECT doc_id, source || '/' || (n_chars % 50) AS num, doc_id % 7 AS d, sha256(text) AS h,
  nullif(trim(regexp_replace(regexp_replace(lower(split_part(text, chr(10), 1)), '[^\p{L}\p{N}\s]', ' ', 'g'), '[\s\p{Z}]+', ' ', 'g')), '') AS f FROM documents),
p AS (SELECT c.doc_id AS candidate_id, x.doc_id AS document_id, c.num = x.num AS n, c.d = x.d AS i, c.h = x.h AS t, c.f = x.f AS tf,
  least(1.0, CASE WHEN c.num = x.num THEN 0.5 ELSE 0 END + CASE WHEN c.d = x.d THEN 0.3 ELSE 0 END + CASE WHEN c.h = x.h THEN 0.2 ELSE 0 END + CASE WHEN c.f = x.f THEN 0.2 ELSE 0 END) AS s
  FROM b c JOIN b x ON (c.num = x.num OR c.h = x.h) AND x.doc_id < c.doc_id),
r AS (SELECT *, CASE WHEN s >= 0.7 THEN 0 ELSE 1 END AS lane, CASE WHEN s >= 0.7 THEN s ELSE 0.95 END AS score FROM p WHERE s >= 0.7 OR t),
o AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY lane, score DESC, document_id) AS k FROM r)
SELECT candidate_id, document_id, CAST(round(score, 6) AS DOUBLE) AS score, concat_ws(',', CASE WHEN n THEN 'document_number' END, CASE WHEN i THEN 'issued_date' END,
  CASE WHEN t THEN 'text_hash' END, CASE WHEN tf THEN 'title_fp' END) AS signals FROM o WHERE k = 1"""


def j13_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with one canonical id for every issuer and day are folded; the result is the repointed sources."""
    d = X.x_docs(spark, sf).withColumn("canonical_id", F.concat_ws("|", "issuer_name", F.col("issued_date").cast("string")))
    _, moved = canonical.merge(d, X.x_srcs(spark, sf))
    return moved.select("document_id", "source_id")


_J13 = with_views("""SELECT k.keep_id AS document_id, s.source_id FROM x_srcs s JOIN (SELECT document_id, min(document_id) OVER (PARTITION BY issuer_name, issued_date) AS keep_id FROM x_docs) k
  ON k.document_id = s.document_id""")


# -- snapshots --------------------------------------------------------------------------------------------------------
def w6_changes(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.changes(snapshots.hashed(X.x_snaps(spark, sf))).select("source_id", "version", "change")


_W6 = with_views("""SELECT source_id, version, CASE WHEN version = 1 THEN 'CREATED' WHEN source_id % 10 = 0 THEN 'CHANGED' ELSE 'UNCHANGED' END AS change FROM x_snaps""")


def j6_current_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    s = X.x_snaps(spark, sf).withColumn("is_current", F.col("version") == 1).withColumn("fetched_at", F.col("version"))
    d = X.load(spark, sf, "documents")
    srcs = d.select(F.col("doc_id").alias("source_id"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") + 1_000_000_000).alias("current_snapshot_id"))
    return snapshots.current(srcs, s).select("source_id", "snapshot_id")


_J6 = "SELECT doc_id AS source_id, CASE WHEN doc_id % 3 = 0 THEN doc_id + 1000000000 ELSE doc_id END AS snapshot_id FROM documents"


def _applied(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    log = snapshots.hashed(X.x_snaps(spark, sf))
    first = log.where("version = 1 AND source_id % 4 <> 0")
    return (first, *snapshots.apply(first, log.where("version = 2")))


def c6_snapshot_log(spark: SparkSession, sf: str) -> DataFrame:
    return _applied(spark, sf)[2]


_C6 = with_views("""SELECT source_id, snapshot_id, CASE WHEN source_id % 4 = 0 THEN 'SOURCE_CREATED' WHEN source_id % 10 = 0 THEN 'SOURCE_CHANGED' ELSE 'CHECKED' END AS event
  FROM x_snaps WHERE version = 2""")


def c23_idempotence(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that a second application of the same input appends: none."""
    first, append, _ = _applied(spark, sf)
    again, _ = snapshots.apply(first.unionByName(append), snapshots.hashed(X.x_snaps(spark, sf)).where("version = 2"))
    return append.agg(F.count(F.lit(1)).alias("n")).select(F.lit("first").alias("run"), "n").unionByName(
        again.agg(F.count(F.lit(1)).alias("n")).select(F.lit("second").alias("run"), "n"))


_C23 = with_views("""SELECT 'first' AS run, count(*) AS n FROM x_snaps WHERE version = 2 AND (source_id % 4 = 0 OR source_id % 10 = 0) UNION ALL SELECT 'second', 0""")


def j15_integrity(spark: SparkSession, sf: str) -> DataFrame:
    s = X.x_snaps(spark, sf)
    return snapshots.integrity(s.where("version = 2 AND source_id % 25 <> 1"), snapshots.hashed(s).where("version = 1")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


_J15 = with_views("""SELECT CASE WHEN source_id % 25 = 1 THEN 'MISSING' WHEN source_id % 10 = 0 THEN 'MISMATCH' ELSE 'VERIFIED' END AS state, count(*) AS n
  FROM x_snaps WHERE version = 1 GROUP BY 1""")


def a20_compare_datasets(spark: SparkSession, sf: str) -> DataFrame:
    s = snapshots.hashed(X.x_snaps(spark, sf)).select("source_id", "version", "page_hash")
    return snapshots.compare_versions(s.where("version = 1").drop("version"), s.where("version = 2").drop("version"))


_A20 = """SELECT count(*) AS rows_before, count(*) AS rows_after, sum(CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END) AS only_before,
  sum(CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END) AS only_after, FALSE AS identical FROM documents"""


# -- sinks ------------------------------------------------------------------------------------------------------------
def s8_insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    t = u3_topics(spark, sf)
    return sinks.new_rows(t, t.where("doc_id % 3 = 0"), ["doc_id", "topic"])


_S8 = f"SELECT doc_id, topic FROM ({_U3}) WHERE doc_id % 3 <> 0"


def s9_upsert(spark: SparkSession, sf: str) -> DataFrame:
    d = X.x_docs(spark, sf).select("document_id", "verification_status", "issuer_name")
    new = d.where("document_id % 5 = 0").select((F.col("document_id") * 2).alias("document_id"), F.lit("conflicting").alias("verification_status"), F.lit(None).cast("string").alias("issuer_name"))
    return sinks.upserted(new, d, ["document_id"])


_S9 = with_views("""SELECT coalesce(d.document_id, n.id) AS document_id, coalesce(n.s, d.verification_status) AS verification_status, d.issuer_name
  FROM x_docs d FULL JOIN (SELECT document_id * 2 AS id, 'conflicting' AS s FROM x_docs WHERE document_id % 5 = 0) n ON n.id = d.document_id""")


def s10_replace_children(spark: SparkSession, sf: str) -> DataFrame:
    p = X.x_provs(spark, sf).select("document_id", "provision_id", "content")
    new = p.where("document_id % 10 = 0 AND provision_id % 2 = 0").withColumn("content", F.upper("content"))
    return sinks.replace_children(p, new, "document_id")


def s10_written(spark: SparkSession, sf: str) -> DataFrame:
    """The same replacement as a write: a table in parts, of which only those with replaced parents are overwritten."""
    p, path = X.x_provs(spark, sf).select("document_id", "provision_id", "content"), new_path(spark, "s10")
    sinks.write_parts(p, path, "document_id", 64)
    sinks.replace_parts(p.where("document_id % 10 = 0 AND provision_id % 2 = 0").withColumn("content", F.upper("content")), path, "document_id", 64)
    return spark.read.parquet(path).drop("part")


_S10 = with_views("""SELECT document_id, provision_id, content FROM x_provs WHERE document_id NOT IN (SELECT document_id FROM x_provs WHERE document_id % 10 = 0 AND provision_id % 2 = 0)
  UNION ALL SELECT document_id, provision_id, upper(content) FROM x_provs WHERE document_id % 10 = 0 AND provision_id % 2 = 0""")

QUERIES = {f.__name__: f for f in (
    f11_metadata, f5_natures, f6_topics, f10_issuers, f17_object_hashes, f18_years, f26_local_dates, f2_dates, f12_identities, f16_hashes, f19_page_text, f1_decoded, f20_tokens, u3_topics, c1_segment, c1_decomposed, f16_decomposed, f19_encoded_text, c2_relationships, c2_all_targets, j12_resolved_edges, c5_dedupe_match,
    j13_merge, w6_changes, j6_current_snapshot, c6_snapshot_log, c23_idempotence, j15_integrity, a20_compare_datasets, s8_insert_ignore, s9_upsert, s10_replace_children, s10_written)}
ORACLE = {
    "c1_decomposed": _C1, "s10_written": _S10, "f16_decomposed": _F16_DECOMPOSED, "f19_encoded_text": _F19, "c2_all_targets": _C2_ALL,
    "f11_metadata": _F11, "f5_natures": _F5, "f6_topics": _F6, "f10_issuers": _F10, "f17_object_hashes": _F17, "f18_years": _F18, "f26_local_dates": _F26, "f2_dates": _F2, "f12_identities": _F12, "f16_hashes": _F16, "f19_page_text": _F19, "f1_decoded": _F1, "f20_tokens": _F20, "u3_topics": _U3,
    "c1_segment": _C1, "c2_relationships": _C2, "j12_resolved_edges": _J12, "c5_dedupe_match": _C5, "j13_merge": _J13, "w6_changes": _W6, "j6_current_snapshot": _J6,
    "c6_snapshot_log": _C6, "c23_idempotence": _C23, "j15_integrity": _J15, "a20_compare_datasets": _A20, "s8_insert_ignore": _S8, "s9_upsert": _S9, "s10_replace_children": _S10}
