"""Queries on scans, landed files, intake and streams."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import snapshots
from ..sources import landed, tables as X
from ..sources.scratch import new_path
from ..sources.tables import with_views
from ..streaming import streams


def s1_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of every base table, each with its fixed schema."""
    parts = [X.load(spark, sf, n).agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("n")) for n in X.SCHEMAS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_S1 = " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {n}" for n in X.SCHEMAS)


def s2_feed_items(spark: SparkSession, sf: str) -> DataFrame:
    """A feed per site of the pages: items with and without guid, one in seven without a link."""
    p = X.load(spark, sf, "pages")
    i = F.col("page_id")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (i % 300).cast("int"))
    item = F.concat(F.lit("<item><title>Nghị định số "), i.cast("string"), F.lit("/2024/NĐ-CP &amp; phụ lục</title>"),
                    F.when(i % 7 != 0, F.concat(F.lit("<link>"), F.regexp_replace(F.regexp_replace("url", "&", "&amp;"), "=", "&#x3D;"), F.lit("</link>"))).otherwise(""),
                    F.when(i % 2 == 0, F.concat(F.lit("<guid isPermaLink=\"false\">g-"), i.cast("string"), F.lit("</guid>"))).otherwise(""),
                    F.lit("<pubDate>Mon, "), F.date_format(day, "d MMM yyyy"), F.lit(" 08:00:00 GMT</pubDate></item>"))
    feeds = p.groupBy((i % 20).cast("string").alias("source_name")).agg(
        F.concat(F.lit("<rss><channel>"), F.array_join(F.array_sort(F.collect_list(item)), ""), F.lit("</channel></rss>")).alias("xml"))
    return landed.feed_items(feeds).select("source_name", "item_id", "url", "title", "published", "document_number")


_S2 = """SELECT CAST(page_id % 20 AS VARCHAR) AS source_name, CASE WHEN page_id % 2 = 0 THEN 'g-' || page_id ELSE url END AS item_id, url,
  'Nghị định số ' || page_id || '/2024/NĐ-CP & phụ lục' AS title, CAST(DATE '2024-01-01' + CAST(page_id % 300 AS INTEGER) AS DATE) AS published,
  page_id || '/2024/NĐ-CP' AS document_number FROM pages WHERE page_id % 7 <> 0"""


def s3_listing_links(spark: SparkSession, sf: str) -> DataFrame:
    return landed.listing_links(X.load(spark, sf, "pages"), r"/[^\"'/]+", "https://list.example").select("url")


_S3 = r"""SELECT DISTINCT 'https://list.example' || h AS url FROM (SELECT unnest(regexp_extract_all(html, '(?is)<a[^>]+href=["''](/[^"''/]+)["''][^>]*>(.*?)</a>', 1)) AS h,
  unnest(regexp_extract_all(html, '(?is)<a[^>]+href=["''](/[^"''/]+)["''][^>]*>(.*?)</a>', 2)) AS t FROM pages)
  WHERE length(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]+>', '', 'g'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '[\s\p{Z}]+', ' ', 'g'))) >= 5"""


def s4_attachments(spark: SparkSession, sf: str) -> DataFrame:
    p = X.load(spark, sf, "pages")
    i = F.col("page_id")
    with_links = p.withColumn("html", F.concat("html", F.when(i % 3 == 0, F.lit('<a href="/f/van-ban.docx">tải</a>')).otherwise(""), F.when(i % 5 == 0, F.lit("<a href='/f/goc.PDF'>pdf</a>")).otherwise("")))
    return landed.attachments(with_links)


_S4 = """SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || CASE WHEN page_id % 5 = 0 THEN '/f/goc.PDF' ELSE '/f/van-ban.docx' END AS attachment_url,
  CASE WHEN page_id % 5 = 0 THEN 'original.pdf' ELSE 'original.docx' END AS kind FROM pages WHERE page_id % 5 = 0 OR page_id % 3 = 0"""


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return X.x_docs(spark, sf)


def s5_html_properties(spark: SparkSession, sf: str) -> DataFrame:
    """Property tables made from documents are read back; a repeated label's last row counts."""
    d = _records(spark, sf)
    row = lambda k, v: F.coalesce(F.concat(F.lit(f"<tr><td class=\"k\"><b>{k}</b></td> <td>"), v, F.lit("&nbsp;</td></tr>")), F.lit(""))
    dmy = lambda c: F.date_format(c, "d/M/yyyy")
    html = F.concat(F.lit("<h1>"), "title", F.lit(" | Cổng</h1><table>"), row("Số hiệu", F.lit("cũ")), row("Số hiệu", F.col("document_number")), row("Cơ quan ban hành", F.col("issuer_name")),
                    row("Ngày ban hành", dmy("issued_date")), row("Ngày có hiệu lực", dmy("effective_from")), row("Ngày hết hiệu lực", F.col("effective_to").cast("string")), F.lit("</table>"))
    pages = d.select(F.col("document_id").alias("page_id"), F.concat(F.lit("https://x.example/?ItemID="), F.col("document_id").cast("string")).alias("url"), html.alias("html"))
    return landed.html_properties(pages).select("page_id", "item_id", "title", "document_number", "issuer", "issued_date", "effective_date", "expiration_date")


_S5 = with_views("""SELECT document_id AS page_id, CAST(document_id AS VARCHAR) AS item_id, title, document_number, issuer_name AS issuer, issued_date, effective_from AS effective_date,
  effective_to AS expiration_date FROM x_docs""")


def s6_xml_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records as XML in three shapes: well-formed, escaped inside an envelope, and broken; all read alike."""
    d = _records(spark, sf)
    i = F.col("document_id")
    tag = lambda k, v: F.coalesce(F.concat(F.lit(f"<{k}>"), v, F.lit(f"</{k}>")), F.lit(""))
    inner = F.concat(F.lit("<VanBan>"), tag("ItemID", i.cast("string")), tag("SoKyHieu", F.col("document_number")), tag("TrichYeu", F.col("title")), tag("TenCQBH", F.col("issuer_name")),
                     tag("NgayBanHanh", F.concat(F.col("issued_date").cast("string"), F.lit("T00:00:00"))), tag("NgayHieuLuc", F.date_format("effective_from", "dd/MM/yyyy")), F.lit("</VanBan>"))
    xml = (F.when(i % 3 == 1, F.concat(F.lit("<R><Result>"), F.regexp_replace(F.regexp_replace(inner, "<", "&lt;"), ">", "&gt;"), F.lit("</Result></R>")))
           .when(i % 3 == 2, F.concat(inner, F.lit("<Mo>"))).otherwise(inner))
    return landed.xml_records(d.select("document_id", xml.alias("xml"))).select("document_id", "item_id", "document_number", "title", "issuer", "issued_date", "effective_date")


_S6 = with_views("""SELECT document_id, CAST(document_id AS VARCHAR) AS item_id, document_number, title, issuer_name AS issuer, issued_date, effective_from AS effective_date FROM x_docs""")


def s7_xml_history(spark: SparkSession, sf: str) -> DataFrame:
    e = X.x_events(spark, sf)
    entry = F.concat(F.lit("<LichSu><Ngay>"), F.date_format("event_date", "dd/MM/yyyy"), F.lit("</Ngay>"),
                     F.when(F.col("event_id") % 9 != 0, F.concat(F.lit("<LoaiSuKien>"), "event_type", F.lit("</LoaiSuKien>"))).otherwise(""), F.lit("</LichSu>"))
    docs = e.groupBy("document_id").agg(F.concat(F.lit("<H>"), F.array_join(F.array_sort(F.collect_list(entry)), ""), F.lit("</H>")).alias("xml"))
    return landed.xml_history(docs).select("document_id", "event_date", "event_type")


_S7 = with_views("SELECT document_id, event_date, event_type FROM x_events WHERE event_id % 9 <> 0")


def s11_object_keys(spark: SparkSession, sf: str) -> DataFrame:
    p = X.load(spark, sf, "pages")
    day = F.date_add(F.lit("2026-01-01").cast("date"), (F.col("page_id") % 365).cast("int"))
    return p.select("page_id", landed.object_key(F.lit("Công Báo-1"), day, F.col("page_id"), F.col("page_id") + 7, F.lit("response.xml")).alias("object_key"))


_S11 = """SELECT page_id, 'raw/c_ng_b_o-1/' || strftime(DATE '2026-01-01' + CAST(page_id % 365 AS INTEGER), '%Y/%m') || '/' || page_id || '/' || (page_id + 7) || '/response.xml' AS object_key FROM pages"""


def p6_admit_urls(spark: SparkSession, sf: str) -> DataFrame:
    """The pages' URLs with some turned into refused ones."""
    i = F.col("page_id") % 8
    url = (F.when(i == 0, F.lit("http://169.254.169.254/latest")).when(i == 1, F.lit("https://user:pw@mof.gov.vn/x")).when(i == 2, F.lit("ftp://mof.gov.vn/x"))
           .when(i == 3, F.lit("https://WWW.mof.gov.vn./x")).when(i == 4, F.lit("https://mof.gov.vn:8443/")).when(i == 5, F.lit("không phải địa chỉ")).otherwise(F.col("url")))
    return landed.admit_urls(X.load(spark, sf, "pages").select("page_id", url.alias("url"))).select("page_id", "reason")


_P6 = """SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'INTERNAL_ADDRESS' WHEN 1 THEN 'USERINFO' WHEN 2 THEN 'SCHEME' WHEN 3 THEN NULL WHEN 4 THEN 'PORT' WHEN 5 THEN 'INVALID_URL'
  ELSE 'NOT_ALLOWED' END AS reason FROM pages"""


# -- intake -----------------------------------------------------------------------------------------------------------
def _items(spark: SparkSession, sf: str) -> DataFrame:
    e = X.x_events(spark, sf)
    return e.select(F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")).alias("source_name"), F.col("event_id").alias("item_id"),
                    F.when(F.col("event_id") % 15 != 0, F.col("event_date")).alias("published"))


_ITEMS = ("items", "SELECT 'u' || (user_id % 10) AS source_name, event_id AS item_id, CASE WHEN event_id % 15 <> 0 THEN event_date END AS published FROM x_events")
_MARKS = ("marks", "SELECT source_name, max(published) AS last_date FROM items WHERE item_id % 3 = 0 AND published <= DATE '2024-01-12' GROUP BY source_name")


def w7_checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.checkpoints(_items(spark, sf).where("published IS NOT NULL"))


_W7 = with_views("""SELECT source_name, published AS last_date, item_id AS last_item FROM (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY published DESC, item_id DESC) AS n
  FROM items WHERE published IS NOT NULL) WHERE n = 1""", _ITEMS)


def _marks(items: DataFrame) -> DataFrame:
    return snapshots.checkpoints(items.where("item_id % 3 = 0 AND published <= DATE '2024-01-12'"))


def c7_admitted_items(spark: SparkSession, sf: str) -> DataFrame:
    items = _items(spark, sf)
    return snapshots.admit(items, _marks(items))


_C7 = with_views("""SELECT i.source_name, item_id, published FROM items i LEFT JOIN marks m ON m.source_name = i.source_name
  WHERE published IS NULL OR last_date IS NULL OR published >= last_date""", _ITEMS, _MARKS)


def j14_match_sources(spark: SparkSession, sf: str) -> DataFrame:
    p = X.load(spark, sf, "pages").select(F.lit("site").alias("source_name"), "url", "page_id")
    known = p.where("url LIKE '%1%'").select("source_name", "url", F.col("page_id").alias("source_id"))
    return snapshots.match_sources(p, known).select("page_id", "source_id", "is_new")


_J14 = """SELECT p.page_id, CASE WHEN k.id IS NULL THEN sha256('site|' || p.url) ELSE CAST(k.id AS VARCHAR) END AS source_id, k.id IS NULL AS is_new FROM pages p
  LEFT JOIN (SELECT url, min(page_id) AS id FROM pages WHERE url LIKE '%1%' GROUP BY url) k ON k.url = p.url"""


# -- streams ----------------------------------------------------------------------------------------------------------
def _stream(spark: SparkSession, sf: str) -> DataFrame:
    return streams.intake(spark, sf, X.SCHEMAS["events"].replace("timestamp_ntz", "timestamp"), "events.parquet")


def t1_intake(spark: SparkSession, sf: str) -> DataFrame:
    return streams.drained(_stream(spark, sf).select("event_id", "event_type", "user_id"), "t1")


_T1 = "SELECT event_id, event_type, user_id FROM events"


def t2_admit(spark: SparkSession, sf: str) -> DataFrame:
    """The late-data rule applied to each micro-batch against a checkpoint table."""
    marks = _marks(_items(spark, sf))
    path = new_path(spark, "t2")
    items = _stream(spark, sf).select(F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")).alias("source_name"), F.col("event_id").alias("item_id"),
                                      F.when(F.col("event_id") % 15 != 0, F.to_date("ts")).alias("published"))

    def write(batch: DataFrame, number: int) -> None:
        streams.admit(batch, marks).write.mode("overwrite").parquet(f"{path}/batch={number}")

    streams.run(items, f"{path}-checkpoint", write=write)
    return spark.read.schema("item_id long, published date, source_name string").parquet(f"{path}/batch=*")


def t3_snapshot_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Two landings of page versions, read one after the other by a stateful stream that remembers hashes."""
    path = new_path(spark, "t3")
    log = snapshots.hashed(X.x_snaps(spark, sf)).select("source_id", "version", *snapshots.HASHES)
    for v in (1, 2):
        log.where(F.col("version") == v).write.mode("append").parquet(f"{path}-in")
        stream = streams.intake(spark, f"{path}-in", "source_id long, version int, page_hash string, text_hash string, metadata_hash string")
        with streams.with_rocksdb(spark):
            streams.run(streams.snapshot_changes(stream), f"{path}-checkpoint", path=f"{path}-out")
    return spark.read.schema("source_id long, version int, change string").parquet(f"{path}-out")


_T3 = """SELECT doc_id AS source_id, 1 AS version, 'CREATED' AS change FROM documents UNION ALL SELECT doc_id, 2, 'CHANGED' FROM documents WHERE doc_id % 10 = 0"""


def t4_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Every event lands twice; each is taken once."""
    twice = _stream(spark, sf).select("event_id", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return streams.drained(streams.dedupe(twice, ["event_id"], "ts", "60 days").select("event_id"), "t4")


_T4 = "SELECT event_id FROM events"


def t5_resume(spark: SparkSession, sf: str) -> DataFrame:
    """Two landings; the second one's write fails after it has begun, and the next run repeats that batch: no row is lost or doubled."""
    path = new_path(spark, "t5")
    rows, tries = X.load(spark, sf, "events").select("event_id", "event_type"), []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}-out/batch={number}")
        tries.append(number)
        if tries == [0, 1]:
            raise RuntimeError("lost while writing")

    for half in (0, 1):
        rows.where(F.col("event_id") % 2 == half).write.mode("append").parquet(f"{path}-in")
        for _ in range(2):
            try:
                streams.run(streams.intake(spark, f"{path}-in", "event_id long, event_type string"), f"{path}-checkpoint", write=write)
                break
            except StreamingQueryException:
                pass
    return spark.read.schema("event_id long, event_type string").parquet(f"{path}-out/batch=*")


_T5 = "SELECT event_id, event_type FROM events"


def t7_drift_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Every record of the documents by source, some without one, some sources with gaps: written or diverted."""
    d, i = X.load(spark, sf, "documents"), F.col("doc_id")
    source = F.when(F.col("lang") == "en", F.col("source"))
    gap = F.coalesce(source, F.lit("none")).isin(*_GAPS) & (i % 4 == 0)
    batch = d.select("doc_id", source.alias("source"), i.cast("string").alias("document_number"), F.lit("t").alias("title"), F.when(~gap, F.lit("2024-01-01")).alias("effective_date"), F.lit("x").alias("issuer"))
    path = new_path(spark, "t7")
    streams.drift_gate(batch, "source", lambda df: df.write.parquet(f"{path}/lane=written"), lambda df: df.write.parquet(f"{path}/lane=diverted"))
    return spark.read.schema("doc_id long, source string, lane string").option("basePath", path).parquet(f"{path}/lane=*")


_GAPS = ("none", "src3", "src7")
_T7 = """SELECT doc_id, s AS source, CASE WHEN bad * 50 > n OR (bad > 1 AND n > 10) THEN 'diverted' ELSE 'written' END AS lane FROM (SELECT doc_id, s, count(*) OVER w AS n,
  sum(CASE WHEN coalesce(s, 'none') IN ('none', 'src3', 'src7') AND doc_id % 4 = 0 THEN 1 ELSE 0 END) OVER w AS bad
  FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN source END AS s FROM documents) WINDOW w AS (PARTITION BY s))"""


def t6_due(spark: SparkSession, sf: str) -> DataFrame:
    q = X.load(spark, sf, "events").select(F.col("event_id").alias("item_id"), (F.col("event_id") % 4).alias("attempts"), F.col("ts").alias("next_retry_at"),
                                           F.when(F.col("event_id") % 5 == 0, F.col("ts") + F.expr("INTERVAL '10' DAY")).alias("lease_until"))
    return streams.due(q, "2024-01-20 00:00:00").select("item_id", "attempts")


_T6 = """SELECT event_id AS item_id, event_id % 4 AS attempts FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:00:00' AND event_id % 4 < 3
  AND (event_id % 5 <> 0 OR ts + INTERVAL 10 DAY < TIMESTAMP '2024-01-20 00:00:00')"""


_T6_KIND = "CASE WHEN event_type IN ('view', 'click') THEN 'claim' WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 'success' ELSE 'failure' END"


def t6_queue_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Claims and results of as many entries as there are users; leases of twelve hours that nobody ends end by themselves. The last state of every entry."""
    messages = _stream(spark, sf).select(F.col("user_id").alias("item_id"), "ts", F.expr(_T6_KIND).alias("kind"))
    with streams.with_rocksdb(spark):
        log = streams.drained(streams.retry_queue(messages, "12 hours"), "t6")
    # Of changes at one moment the later one has more attempts or holds a lease.
    last = log.groupBy("item_id").agg(F.max_by(F.struct("state", "attempts", "next_retry_at"), F.struct("at", "attempts", F.col("lease_until").isNotNull(), (F.col("state") == "done"))).alias("e"))
    return last.select("item_id", "e.state", "e.attempts", F.col("e.next_retry_at").cast("timestamp_ntz").alias("next_retry_at"))


#: The messages of an entry one after the other, to milliseconds as the stream takes them.
_T6S = f"""WITH RECURSIVE m AS (SELECT user_id AS item_id, epoch_us(ts) // 1000 AS ts, {_T6_KIND} AS kind, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, {_T6_KIND}) AS n FROM events),
step AS (SELECT item_id, 0::BIGINT AS n, 'waiting' AS state, 0 AS attempts, ts AS due, NULL::BIGINT AS lease FROM m WHERE n = 1
  UNION ALL SELECT item_id, n, CASE WHEN kind = 'failure' AND lease IS NOT NULL AND attempts + 1 >= 3 THEN 'failed' WHEN kind = 'success' AND lease IS NOT NULL THEN 'done' ELSE state END,
    CASE WHEN kind = 'failure' AND lease IS NOT NULL THEN attempts + 1 ELSE attempts END,
    CASE WHEN kind = 'failure' AND lease IS NOT NULL THEN ts + CASE attempts WHEN 0 THEN 6 WHEN 1 THEN 24 ELSE 0 END * 3600000 ELSE due END,
    CASE WHEN kind = 'claim' AND state = 'waiting' AND due <= ts AND lease IS NULL THEN ts + 43200000 WHEN kind IN ('failure', 'success') THEN NULL ELSE lease END
  FROM (SELECT s.item_id, m.n, m.ts, m.kind, CASE WHEN lease < m.ts AND attempts + 1 >= 3 THEN 'failed' ELSE state END AS state, CASE WHEN lease < m.ts THEN attempts + 1 ELSE attempts END AS attempts,
      CASE WHEN lease < m.ts THEN lease + CASE attempts WHEN 0 THEN 6 WHEN 1 THEN 24 ELSE 0 END * 3600000 ELSE due END AS due, CASE WHEN lease < m.ts THEN NULL ELSE lease END AS lease
    FROM step s JOIN m ON m.item_id = s.item_id AND m.n = s.n + 1)),
ended AS (SELECT * FROM step WHERE (item_id, n) IN (SELECT (item_id, max(n)) FROM m GROUP BY item_id)),
late AS (SELECT *, lease IS NOT NULL AND lease <= (SELECT epoch_us(max(ts)) // 1000 - 3600000 FROM events) AS over FROM ended)
SELECT item_id, CASE WHEN over AND attempts + 1 >= 3 THEN 'failed' ELSE state END AS state, CASE WHEN over THEN attempts + 1 ELSE attempts END AS attempts,
  CAST(make_timestamp((CASE WHEN over THEN lease + CASE attempts WHEN 0 THEN 6 WHEN 1 THEN 24 ELSE 0 END * 3600000 ELSE due END) * 1000) AS TIMESTAMP) AS next_retry_at FROM late"""


def f27_next_retry(spark: SparkSession, sf: str) -> DataFrame:
    """Whether every rescheduled entry waits 6, 24 or 72 hours, a fifth more or less."""
    now = "2024-02-01 00:00:00"
    q = X.load(spark, sf, "events").select(F.col("event_id").alias("item_id"), (F.col("event_id") % 3).cast("int").alias("attempts"), F.col("ts").alias("next_retry_at"))
    r = streams.reschedule(q, now)
    hours = (F.unix_timestamp(F.col("next_retry_at").cast("timestamp")) - F.unix_timestamp(F.lit(now).cast("timestamp"))) / 3600
    base = F.element_at(F.array(F.lit(6), F.lit(24), F.lit(72)), F.col("attempts"))
    return r.select("item_id", "attempts", hours.between(base * 0.8 - 0.01, base * 1.2 + 0.01).alias("in_bounds"))


_F27 = "SELECT event_id AS item_id, event_id % 3 + 1 AS attempts, TRUE AS in_bounds FROM events"


def t8_alert_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly counts of each type and whether they exceed twice the mean of the 24 counted hours before."""
    return streams.alerts(X.load(spark, sf, "events").groupBy(F.date_trunc("hour", F.col("ts")).alias("window_start"), "event_type").agg(F.count(F.lit(1)).alias("n")))


_T8 = """SELECT window_start, event_type, n, round(avg(n) OVER w, 6) AS trailing_mean, coalesce(n > round(avg(n) OVER w, 6) * 2, FALSE) AS alert FROM (
  SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2) WINDOW w AS (PARTITION BY event_type ORDER BY window_start ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)"""


def t8_stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows the stream has closed: those that end an hour or more before the last event."""
    return streams.drained(streams.windows(_stream(spark, sf)), "t8").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


_T8S = """SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2
  HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"""


def t8_sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Six-hour windows that begin every two hours."""
    wide = streams.windows(_stream(spark, sf), "6 hours", "1 hour", "2 hours")
    return streams.drained(wide, "t8w").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


_T8W = """SELECT window_start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 2 HOUR, ts), time_bucket(INTERVAL 2 HOUR, ts) - INTERVAL 2 HOUR,
  time_bucket(INTERVAL 2 HOUR, ts) - INTERVAL 4 HOUR]) AS window_start FROM events) WHERE window_start + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY ALL"""


def t8_stream_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Closed hours of each type, empty ones too, against the day before them."""
    with streams.with_rocksdb(spark):
        out = streams.drained(streams.stream_alerts(_stream(spark, sf).where("event_id % 3 = 0").select("event_type", "ts")), "t8a")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


_T8A = """SELECT h AS window_start, event_type, n, round(avg(n) OVER w, 6) AS trailing_mean, coalesce(n > round(avg(n) OVER w, 6) * 2, FALSE) AS alert FROM (
  SELECT s.event_type, h, coalesce(c.n, 0) AS n FROM (SELECT event_type, unnest(generate_series(date_trunc('hour', min(ts)), (SELECT max(ts) FROM events WHERE event_id % 3 = 0) - INTERVAL 2 HOUR, INTERVAL 1 HOUR)) AS h
    FROM events WHERE event_id % 3 = 0 GROUP BY event_type) s LEFT JOIN (SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events WHERE event_id % 3 = 0 GROUP BY ALL) c ON c.event_type = s.event_type AND c.hour = s.h)
  WINDOW w AS (PARTITION BY event_type ORDER BY h ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)"""


def t9_stream_updates(spark: SparkSession, sf: str) -> DataFrame:
    docs = X.x_docs(spark, sf)
    n = X.load(spark, sf, "orders").count()
    e = _stream(spark, sf).select("event_id", (F.col("event_id") % F.lit(max(n, 1))).alias("document_id"))
    return streams.drained(streams.latest_updates(e, docs), "t9").select("event_id", "document_id", "document_number")


_T9 = with_views("SELECT event_id, e.document_id, document_number FROM x_events e JOIN x_docs d ON d.document_id = e.document_id")


def t10_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    items = streams.backfill(_items(spark, sf), "2024-01-05", "2024-01-20")
    return streams.reconcile(items, items.where("item_id % 6 <> 0"), ["source_name", "item_id"])


_T10 = with_views("SELECT source_name, item_id, published FROM items WHERE published BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND item_id % 6 = 0", _ITEMS)

QUERIES = {f.__name__: f for f in (
    s1_scan, s2_feed_items, s3_listing_links, s4_attachments, s5_html_properties, s6_xml_records, s7_xml_history, s11_object_keys, p6_admit_urls, w7_checkpoints, c7_admitted_items,
    j14_match_sources, t1_intake, t2_admit, t3_snapshot_changes, t4_dedupe, t5_resume, t7_drift_gate, t6_due, t6_queue_stream, f27_next_retry, t8_alert_windows, t8_stream_windows, t8_sliding_windows, t8_stream_alerts, t9_stream_updates, t10_reconcile)}
ORACLE = {
    "s1_scan": _S1, "s2_feed_items": _S2, "s3_listing_links": _S3, "s4_attachments": _S4, "s5_html_properties": _S5, "s6_xml_records": _S6, "s7_xml_history": _S7, "s11_object_keys": _S11,
    "p6_admit_urls": _P6, "w7_checkpoints": _W7, "c7_admitted_items": _C7, "j14_match_sources": _J14, "t1_intake": _T1, "t2_admit": _C7, "t3_snapshot_changes": _T3, "t4_dedupe": _T4,
    "t5_resume": _T5, "t7_drift_gate": _T7, "t6_due": _T6, "t6_queue_stream": _T6S, "f27_next_retry": _F27, "t8_alert_windows": _T8, "t8_stream_windows": _T8S, "t8_sliding_windows": _T8W, "t8_stream_alerts": _T8A, "t9_stream_updates": _T9, "t10_reconcile": _T10}
