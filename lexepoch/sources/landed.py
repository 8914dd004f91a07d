"""Landed feed, listing, HTML and XML files to typed rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T

#: Domains that official pages come from, and labels and tags of the second source's fields.
OFFICIAL_DOMAINS = ("congbao.chinhphu.vn", "chinhphu.vn", "vanban.chinhphu.vn", "mof.gov.vn", "gdt.gov.vn", "customs.gov.vn",
                    "moj.gov.vn", "data.gov.vn", "vbpl.vn", "ws.vbpl.vn")
HTML_LABELS = {
    "document_number": ("số ký hiệu", "số hiệu"), "issuer": ("cơ quan ban hành",), "issued_date": ("ngày ban hành",),
    "effective_date": ("ngày có hiệu lực", "ngày hiệu lực"), "expiration_date": ("ngày hết hiệu lực",),
    "status_metadata": ("tình trạng hiệu lực", "hiệu lực"), "document_type": ("loại văn bản",), "signer": ("người ký",),
    "replaces": ("văn bản bị thay thế", "thay thế cho"), "repeals": ("văn bản bị bãi bỏ", "bãi bỏ"),
    "amends": ("văn bản sửa đổi, bổ sung", "sửa đổi bổ sung cho")}
XML_TAGS = {
    "item_id": ("ItemID", "VanBanID", "Id", "DocID", "ID"), "document_number": ("SoKyHieu", "DocumentNumber", "SoHieu", "DocNumber"),
    "title": ("TrichYeu", "Title", "TenVanBan", "TieuDe"), "issuer": ("CoQuanBanHanh", "Issuer", "TenCQBH", "CoQuan"),
    "issued_date": ("NgayBanHanh", "IssuedDate", "NgayKy"), "effective_date": ("NgayHieuLuc", "EffectiveDate", "NgayCoHieuLuc"),
    "expiration_date": ("NgayHetHieuLuc", "ExpirationDate", "NgayHetLuc"), "status_metadata": ("TinhTrangHieuLuc", "Status", "TrangThai", "HieuLuc"),
    "document_type": ("LoaiVanBan", "DocumentType", "TenLoaiVB"), "signer": ("NguoiKy", "Signer", "HoTenNguoiKy")}
HISTORY_TAGS = {"event_date": ("NgaySuKien", "Ngay", "NgayCapNhat", "EventDate"), "event_type": ("LoaiSuKien", "SuKien", "EventType"),
                "description": ("NoiDung", "MoTa", "Description")}
DATES = ("issued_date", "effective_date", "expiration_date", "event_date")


def _tag(xml: Column, name: str) -> Column:
    """Text of the first element of a name, in any case and with any prefix."""
    return F.nullif(F.trim(F.regexp_extract(xml, rf"(?is)<(?:\w+:)?{name}(?:\s[^>]*)?>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</(?:\w+:)?{name}>", 1)), F.lit(""))


def feed_items(xml: DataFrame) -> DataFrame:
    """Items of RSS texts (source_name, xml): item_id is the guid or else the link; items without title or link are dropped.

    Entities, numeric ones too, are decoded in title, link and guid, so links are those of the pages.
    """
    items = xml.select("source_name", F.explode(F.regexp_extract_all("xml", F.lit(r"(?is)<item(?:\s[^>]*)?>(.*?)</item>"), 1)).alias("i"))
    i = F.col("i")
    pub = F.regexp_extract(_tag(i, "pubDate"), r"([0-9]{1,2}) ([A-Za-z]{3}) ([0-9]{4})", 0)
    found = items.select("source_name", T.decode_entities(_tag(i, "title")).alias("title"), T.decode_entities(_tag(i, "link")).alias("url"), T.decode_entities(_tag(i, "guid")).alias("guid"),
                         F.try_to_date(F.concat(F.when(F.length(pub) == 10, "0").otherwise(""), pub), "dd MMM yyyy").alias("published"))
    return found.where("title IS NOT NULL AND url IS NOT NULL").select(
        "source_name", F.coalesce("guid", "url").alias("item_id"), "title", "url", "published", T.document_number(F.col("title")).alias("document_number"))


def listing_links(pages: DataFrame, pattern: str, base: str, least: int = 5) -> DataFrame:
    """(url, title) of links whose address matches pattern: tags stripped, short titles dropped, each URL once."""
    link = rf"(?is)<a[^>]+href=[\"']({pattern})[\"'][^>]*>(.*?)</a>"
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit(link), 1).alias("h"), F.regexp_extract_all("html", F.lit(link), 2).alias("t"))
    rows = pages.select("page_id", F.explode(pairs).alias("l")).select(
        F.concat(F.lit(base), "l.h").alias("url"), T.decode_entities(F.regexp_replace("l.t", "<[^>]+>", "")).alias("t"), "page_id")
    titled = rows.withColumn("title", F.trim(F.regexp_replace("t", r"(?U)\s+", " "))).where(F.length("title") >= least)
    return titled.groupBy("url").agg(F.min_by("title", F.struct("page_id", "title")).alias("title"))


def absolute(href: Column, url: Column) -> Column:
    origin = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    return F.when(href.startswith("http"), href).otherwise(F.concat(origin, href))


def attachments(pages: DataFrame) -> DataFrame:
    """(page_id, attachment_url, kind): the first PDF link, else the first DOCX link, absolute."""
    first = lambda kind: F.nullif(F.regexp_extract("html", rf"(?i)href=[\"'](https?://[^\"']+\.{kind}|/[^\"']+\.{kind})[\"']", 1), F.lit(""))
    pdf, docx = first("pdf"), first("docx")
    return pages.select("page_id", absolute(F.coalesce(pdf, docx), F.col("url")).alias("attachment_url"),
                        F.when(pdf.isNotNull(), "original.pdf").when(docx.isNotNull(), "original.docx").alias("kind")).where("kind IS NOT NULL")


def _labelled(label: str):
    return lambda x: x["k"] == label


def html_properties(pages: DataFrame, labels: dict[str, tuple[str, ...]] = HTML_LABELS) -> DataFrame:
    """One record per page from its two-column table rows; of repeated labels the last counts, of aliases the first."""
    row = r"(?is)<tr[^>]*>\s*<td[^>]*>(.*?)</td>\s*<td[^>]*>(.*?)</td>"
    pairs = F.arrays_zip(F.transform(F.regexp_extract_all("html", F.lit(row), 1), lambda x: F.lower(T.strip_tags(x))).alias("k"),
                         F.transform(F.regexp_extract_all("html", F.lit(row), 2), lambda x: T.strip_tags(x)).alias("v"))
    p = pages.withColumn("_p", pairs)

    def value(aliases: tuple[str, ...]) -> Column:
        one = [F.nullif(F.try_element_at(F.filter("_p", _labelled(a)), F.lit(-1))["v"], F.lit("")) for a in aliases]
        return F.coalesce(*one)

    title = F.trim(F.element_at(F.split(T.strip_tags(F.coalesce(F.nullif(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1), F.lit("")),
                                                              F.regexp_extract("html", r"(?i)<title>([^<]+)</title>", 1))), r"\|"), 1))
    item = F.coalesce(*[F.nullif(F.regexp_extract(c, r"(?i)ItemID=([0-9]+)", 1), F.lit("")) for c in ("url", "html")])
    return p.select("page_id", item.alias("item_id"), title.alias("title"),
                    *[(T.normalize_date(value(a)) if f in DATES else value(a)).alias(f) for f, a in labels.items()])


def xml_records(df: DataFrame, tags: dict[str, tuple[str, ...]] = XML_TAGS, column: str = "xml") -> DataFrame:
    """One record per XML text: well-formed records by schema, names missed there (case, prefixes, broken XML) by pattern.

    XML escaped inside an element is unescaped first.
    """
    xml = F.when(F.col(column).contains("&lt;"), T.named_entities(F.col(column))).otherwise(F.col(column))
    names = list(dict.fromkeys(n for a in tags.values() for n in a))
    distinct = list({n.lower(): n for n in reversed(names)}.values())
    parsed = F.from_xml(xml, "struct<" + ", ".join(f"`{n}`: string" for n in distinct) + ">", {"mode": "PERMISSIVE"})
    d = df.withColumn("_xml", xml).withColumn("_r", parsed)

    def value(aliases: tuple[str, ...]) -> Column:
        tries = [F.nullif(F.trim(F.col(f"_r.{n}")), F.lit("")) for n in aliases if n in distinct] + [_tag(F.col("_xml"), n) for n in aliases]
        return F.coalesce(*tries)

    return d.select(*[c for c in df.columns if c != column], *[(T.normalize_date(value(a)) if f in DATES else value(a)).alias(f) for f, a in tags.items()])


def xml_history(df: DataFrame, entry: str = "LichSu", column: str = "xml") -> DataFrame:
    """Dated events of history texts: entries need a date and an event type or description."""
    rows = df.select(*[c for c in df.columns if c != column], F.explode(F.regexp_extract_all(column, F.lit(rf"(?is)<{entry}(?:\s[^>]*)?>(.*?)</{entry}>"), 1)).alias("_e"))
    value = lambda a: F.coalesce(*[_tag(F.col("_e"), n) for n in a])
    out = rows.select("*", *[(T.normalize_date(value(a)) if f in DATES else value(a)).alias(f) for f, a in HISTORY_TAGS.items()]).drop("_e")
    return out.where("event_date IS NOT NULL AND (event_type IS NOT NULL OR description IS NOT NULL)")


def admit_urls(df: DataFrame, allow: tuple[str, ...] = OFFICIAL_DOMAINS, allow_local: bool = False) -> DataFrame:
    """df with host and reason: null for an admitted URL, else why it is refused."""
    url = F.coalesce(F.col("url"), F.lit(""))
    parts = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#\\]*)"
    scheme, authority = F.lower(F.regexp_extract(url, parts, 1)), F.regexp_extract(url, parts, 2)
    bare = F.regexp_replace(authority, r"^.*@", "")
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r":[0-9]*$", ""), r"\.+$", ""), r"[\[\]]", ""))
    port = F.regexp_extract(bare, r":([0-9]+)$", 1)
    inner = (host.startswith("10.") | host.startswith("192.168.") | host.rlike(r"^172\.(1[6-9]|2[0-9]|3[0-1])\.") | host.isin("169.254.169.254", "127.0.0.1", "::1")
             | reduce(lambda a, b: a | b, [host.startswith(p) for p in ("fe80:", "fc00:", "fd00:", "::ffff:")]))
    listed = reduce(lambda a, b: a | b, [(host == d) | host.endswith("." + d) for d in allow]) if allow else F.lit(False)
    local = host.isin("localhost", "127.0.0.1", "::1") | host.endswith(".local")
    reason = (F.when(authority == "", "INVALID_URL").when(~scheme.isin("http", "https"), "SCHEME").when(authority.contains("@"), "USERINFO"))
    if allow_local:
        reason = reason.when(local, None)
    else:
        reason = reason.when((port != "") & ~port.isin("80", "443"), "PORT")
    return df.withColumn("host", host).withColumn("reason", reason.when(inner, "INTERNAL_ADDRESS").when(~listed, "NOT_ALLOWED"))


def object_key(source: Column, day: Column, source_id: Column, snapshot_id: Column, file: Column) -> Column:
    """raw/{source}/{yyyy}/{MM}/{source_id}/{snapshot_id}/{file}"""
    return F.concat_ws("/", F.lit("raw"), F.regexp_replace(F.lower(source), "[^a-z0-9_-]", "_"), F.date_format(day, "yyyy"), F.date_format(day, "MM"),
                       source_id.cast("string"), snapshot_id.cast("string"), file)
