"""Column functions on titles and texts (F1-F30). All are built-in expressions but nfc."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# -- fixed values -----------------------------------------------------------------------------------------------------
TYPE_RULES = [
    ("luật", "law"), ("nghị định", "decree"), ("thông tư liên tịch", "joint_circular"), ("thông tư", "circular"),
    ("nghị quyết", "resolution"), ("pháp lệnh", "ordinance"), ("quyết định", "decision"), ("công văn", "official_letter"),
    ("công điện", "dispatch"), ("hướng dẫn", "guidance"), ("thông báo", "announcement")]
BODY_TYPE_RULES = [("nghị định", "decree"), ("thông tư", "circular"), ("luật", "law")]
NATURE_RULES = [
    (("lấy ý kiến", "góp ý"), "consultation"), (("dự thảo",), "draft"), (("tờ trình",), "proposal"),
    (("văn bản hợp nhất",), "consolidated_document"), (("đính chính",), "correction")]
NORMATIVE_TYPES = ("law", "decree", "circular", "joint_circular", "resolution", "ordinance")
GUIDANCE_TYPES = ("official_letter", "dispatch", "guidance")
NORMATIVE_DECISION = ("quy phạm pháp luật", "ban hành quy định", "quy chế")
TOPIC_RULES = [
    ("vat", ("giá trị gia tăng", "gtgt", "vat")), ("cit", ("thu nhập doanh nghiệp", "tndn", "cit")),
    ("pit", ("thu nhập cá nhân", "tncn", "pit")), ("invoice", ("hóa đơn", "chứng từ")), ("tax_administration", ("quản lý thuế",)),
    ("household_business", ("hộ kinh doanh", "cá nhân kinh doanh")), ("special_consumption_tax", ("tiêu thụ đặc biệt", "ttđb")),
    ("import_export_duty", ("xuất khẩu", "nhập khẩu", "hải quan")), ("customs", ("hải quan",)),
    ("transfer_pricing", ("giao dịch liên kết", "chuyển giá")), ("fct", ("nhà thầu", "fct")),
    ("penalties_and_enforcement", ("xử phạt", "vi phạm hành chính", "cưỡng chế")), ("land_tax", ("tiền thuê đất", "sử dụng đất")),
    ("accounting", ("kế toán",))]
ISSUER_RULES = [("chính phủ", "Chính phủ"), ("bộ tài chính", "Bộ Tài chính"), ("tổng cục thuế", "Tổng cục Thuế"),
                ("quốc hội", "Quốc hội"), ("thủ tướng", "Thủ tướng Chính phủ")]
CORPUS_ISSUERS = [
    ("chính phủ", ("/nđ-cp", "/nq-cp"), "Chính phủ"), ("thủ tướng", ("/qđ-ttg",), "Thủ tướng Chính phủ"),
    ("bộ tài chính", ("/tt-btc",), "Bộ Tài chính"), ("quốc hội", ("/qh",), "Quốc hội"),
    ("ngân hàng nhà nước", ("/tt-nhnn",), "Ngân hàng Nhà nước"), ("tổng cục thuế", ("/tct-",), "Tổng cục Thuế")]
OTHER_ISSUER = "Cơ quan ban hành khác"
TYPE_CODES = {"constitution": "HP", "law": "LUAT", "resolution": "NQ", "ordinance": "PL", "decree": "ND", "decision": "QD",
              "circular": "TT", "joint_circular": "TTLT", "official_letter": "CV", "dispatch": "CD", "guidance": "HD",
              "announcement": "TB", "other": "VB"}
DATE_PHRASE = r"([0-9]{1,2}\s+tháng\s+[0-9]{1,2}\s+năm\s+[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})"
ACCENTED = "ĐÀÁẢÃẠÂẦẤẨẪẬĂẰẮẲẴẶÈÉẺẼẸÊỀẾỂỄỆÌÍỈĨỊÒÓỎÕỌÔỒỐỔỖỘƠỜỚỞỠỢÙÚỦŨỤƯỪỨỬỮỰỲÝỶỸỴ"
RETRY_HOURS = (6, 24, 72)


def plain_letters(accented: str = ACCENTED) -> str:
    """The base letter of each accented one."""
    return "".join("D" if c == "Đ" else unicodedata.normalize("NFD", c)[0] for c in accented)


def let(value: Column, body) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


# -- code points ------------------------------------------------------------------------------------------------------
#: Combining marks that ``composed`` joins to letters, those that attach below or beside a letter first.
MARKS = "\u0327\u0328\u031b\u0323\u0302\u0306\u0304\u0307\u0308\u030a\u030b\u030c\u0300\u0301\u0303\u0309"
_LATIN = [chr(i) for i in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x2B0), *range(0x1E00, 0x1F00))]


def _joins(mark: str) -> tuple[str, str]:
    """Letters that the mark joins to one letter, and those letters."""
    pairs = [(c, unicodedata.normalize("NFC", c + mark)) for c in _LATIN]
    return "".join(c for c, x in pairs if len(x) == 1), "".join(x for _, x in pairs if len(x) == 1)


def composed(c: Column) -> Column:
    """NFC of Latin text by built-in expressions: letters with marks after them, in any order, become one letter.

    Texts without marks pass at the price of one look. A mark that joins no letter stays as it is; ``nfc`` is the
    complete form for all scripts.
    """
    def compose(text: Column) -> Column:
        # Marks of an earlier class stand before others (the canonical order), then each mark joins the letter before it.
        low, high = MARKS[:4], MARKS[4:]
        for _ in range(2):
            text = F.regexp_replace(text, f"([{high}])([{low}])", "$2$1")
            for i in (1, 2, 3):
                text = F.regexp_replace(text, f"([{low[i:]}])([{low[:i]}])", "$2$1")
        for mark in MARKS + high:  # a letter may take two of the others, in the order in which they stand
            text = let(text, _joining(mark))
        return text

    # The look is at the range in which all marks lie, as one range is found much faster than a set of letters; ASCII texts need none.
    return let(c, lambda t: F.when((F.octet_length(t) != F.length(t)) & t.rlike(f"[{min(MARKS)}-{max(MARKS)}]"), compose(t)).otherwise(t))


def _joining(mark: str):
    bases, wholes = _joins(mark)

    def join(text: Column) -> Column:
        parts = F.split(text, mark)

        def part(p: Column, i: Column) -> Column:
            last = F.substring(p, -1, 1)
            fits = (p != "") & F.contains(F.lit(bases), last)
            return (F.when(i == F.size(parts) - 1, p).when(fits, F.concat(F.substring(p, F.lit(1), F.length(p) - 1), F.translate(last, bases, wholes)))
                    .otherwise(F.concat(p, F.lit(mark))))

        return F.when(F.contains(text, F.lit(mark)), F.array_join(F.transform(parts, part), "")).otherwise(text)

    return join


@F.pandas_udf(StringType())
def _nfc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(c: Column) -> Column:
    """Unicode NFC of any script, by an Arrow function."""
    return _nfc(c)


def _character(n: Column) -> Column:
    """The character of a code point; null where there is none."""
    unit = lambda x: F.lpad(F.hex(x), 4, "0")
    high, low = F.lit(0xD800) + F.floor((n - 0x10000) / 1024), F.lit(0xDC00) + (n - 0x10000) % 1024
    units = F.when((n < 0xD800) | n.between(0xE000, 0xFFFF), unit(n)).when(n.between(0x10000, 0x10FFFF), F.concat(unit(high), unit(low)))
    return F.decode(F.unhex(units), "UTF-16BE")


def numeric_entities(c: Column) -> Column:
    """Hexadecimal references, then decimal ones, as characters; references to no character stay as they are."""
    def decoded(text: Column, pattern: str, number) -> Column:
        def join(part: Column, ref: Column) -> Column:
            return F.concat(part, F.coalesce(_character(number(ref)), ref, F.lit("")))
        return F.when(text.rlike(pattern), F.array_join(F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0), join), "")).otherwise(text)

    hexadecimal = lambda r: F.conv(F.regexp_extract(r, "[xX]0*([0-9a-fA-F]{1,8});", 1), 16, 10).try_cast("long")
    decimal = lambda r: F.regexp_extract(r, "#0*([0-9]{1,9});", 1).try_cast("long")
    both = lambda t: let(decoded(t, "&#[xX][0-9a-fA-F]+;", hexadecimal), lambda u: decoded(u, "&#[0-9]+;", decimal))
    return let(c, lambda t: F.when(F.contains(t, F.lit("&#")), both(t)).otherwise(t))


def named_entities(c: Column) -> Column:
    for name, value in (("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")):
        c = F.replace(c, F.lit(name), F.lit(value))
    return c


def decode_entities(c: Column) -> Column:
    """numeric entities, then the named ones in their fixed order."""
    return named_entities(numeric_entities(c))


# -- dates ------------------------------------------------------------------------------------------------------------
def _date(year: Column, month: Column, day: Column) -> Column:
    pad = lambda x: F.lpad(x, 2, "0")
    return F.when(year != "", F.try_to_date(F.concat_ws("-", year, pad(month), pad(day)), "yyyy-MM-dd"))


def vn_date(c: Column) -> Column:
    """'ngày d tháng m năm yyyy', else d/m/yyyy, the first match; an impossible date is null."""
    long = r"(?iu)ngày\s+0?([1-9]|[12][0-9]|3[01])\s+tháng\s+0?([1-9]|1[0-2])\s+năm\s+((?:19|20)[0-9]{2})"
    short = r"0?([1-9]|[12][0-9]|3[01])/0?([1-9]|1[0-2])/((?:19|20)[0-9]{2})"
    read = lambda m, p: _date(*[F.regexp_extract(m, p, i) for i in (3, 2, 1)])
    return let(F.regexp_extract(c, long, 0), lambda m: F.when(m != "", read(m, long)).otherwise(
        let(F.regexp_extract(c, short, 0), lambda n: read(n, short))))


def normalize_date(c: Column) -> Column:
    """ISO prefix, d/m/yyyy prefix, else what a timestamp cast reads."""
    t = F.trim(c)
    iso, dmy = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})", r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})"
    part = lambda p, i: F.regexp_extract(t, p, i)
    return F.coalesce(_date(part(iso, 1), part(iso, 2), part(iso, 3)), _date(part(dmy, 3), part(dmy, 2), part(dmy, 1)),
                      F.to_date(F.try_to_timestamp(t)))


def effective_from(text: Column) -> Column:
    """F8: the date after 'có hiệu lực / hiệu lực thi hành / áp dụng (kể) từ ngày'."""
    phrase = F.regexp_extract(text, r"(?iu)(?:có hiệu lực|hiệu lực thi hành|áp dụng)(?:\s+kể)?\s+từ\s+ngày\s+" + DATE_PHRASE, 1)
    return let(phrase, lambda p: F.when(p != "", vn_date(F.concat(F.lit("ngày "), p))))


def clause_date(text: Column, verbs: str) -> Column:
    phrase = F.regexp_extract(text, rf"(?iu)(?:{verbs})(?:\s+kể)?\s+từ\s+ngày\s+" + DATE_PHRASE, 1)
    return let(phrase, lambda p: F.when(p != "", vn_date(F.concat(F.lit("ngày "), p))))


def local_today(ts: Column) -> Column:
    """the date in the corpus' legal time zone."""
    return F.to_date(F.from_utc_timestamp(ts, "Asia/Ho_Chi_Minh"))


# -- classes ----------------------------------------------------------------------------------------------------------
def _any(c: Column, words) -> Column:
    out = c.contains(words[0])
    for w in words[1:]:
        out = out | c.contains(w)
    return out


def _first(c: Column, rules, default) -> Column:
    out = None
    for word, value in rules:
        hit = c.contains(word)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(default)


def _head(text: Column, n: int = 1000) -> Column:
    return F.lower(F.substring(F.coalesce(text, F.lit("")), 1, n))


def document_type(title: Column, text: Column | None = None) -> Column:
    """ordered rules on the title, then on the text's first 1000 characters; the order is part of the meaning."""
    rest = F.lit("other") if text is None else let(_head(text), lambda h: _first(h, BODY_TYPE_RULES, "other"))
    return let(F.lower(title), lambda t: _first(t, TYPE_RULES, rest))


def document_nature(title: Column, kind: Column, text: Column | None = None) -> Column:
    """F5."""
    both = F.lower(title) if text is None else F.concat(F.lower(title), F.lit(" "), _head(text))

    def of(both: Column, kind: Column) -> Column:
        out = None
        for words, value in NATURE_RULES:
            out = F.when(_any(both, words), value) if out is None else out.when(_any(both, words), value)
        return (out.when(kind.isin(*NORMATIVE_TYPES), "normative_legal_document")
                .when(kind.isin(*GUIDANCE_TYPES) | both.contains("hướng dẫn"), "official_guidance")
                .when((kind == "decision") & _any(both, NORMATIVE_DECISION), "normative_legal_document")
                .when(kind.isin("decision", "announcement"), "administrative_document").otherwise("other"))

    return let(both, lambda b: let(kind, lambda k: of(b, k)))


def topics(text: Column, rules=None, default: str = "other") -> Column:
    """The topics whose words occur; [default] when none."""
    found = lambda low: F.array_compact(F.array(*[F.when(_any(low, words), name) for name, words in rules or TOPIC_RULES]))
    return let(let(F.lower(text), found), lambda f: F.when(F.size(f) == 0, F.array(F.lit(default))).otherwise(f))


def issuer(title: Column) -> Column:
    """F9."""
    return _first(F.lower(title), ISSUER_RULES, None)


def corpus_issuer(given: Column, title: Column, number: Column) -> Column:
    """what is given, else by title or number, else the other body."""
    t, n = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(number, F.lit("")))
    out = None
    for word, suffixes, name in CORPUS_ISSUERS:
        hit = t.contains(word) | _any(n, suffixes)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.coalesce(F.nullif(F.trim(given), F.lit("")), out.otherwise(OTHER_ISSUER))


# -- numbers and identities -------------------------------------------------------------------------------------------
def document_number(title: Column, text: Column | None = None, strict_parity: bool = False) -> Column:
    """after 'số' in the title, else after 'Số:' in the text's first 1500 characters; it begins with a digit."""
    first = "" if strict_parity else "[0-9]"
    found = F.nullif(F.regexp_extract(title, rf"(?iu)số\s*[:.]?\s*({first}[0-9A-Za-zĐđ_./-]+)", 1), F.lit(""))
    if text is None:
        return found
    return F.coalesce(found, F.nullif(F.regexp_extract(F.substring(text, 1, 1500), rf"(?iu)Số\s*:\s*({first}[0-9A-Za-zĐđ_./-]+)", 1), F.lit("")))


def normalize_number(c: Column) -> Column:
    """composed, upper case, plain dashes and letters, no white space, no final punctuation."""
    up = F.translate(F.upper(composed(c)), "–—" + ACCENTED, "--" + plain_letters())
    return F.regexp_replace(F.regexp_replace(up, r"(?U)\s+", ""), r"[.,;:]+$", "")


def canonical_id(kind: Column, number: Column, issued: Column, natural_key: Column, year: int | None = None) -> Column:
    """VN:{code}:{year}:{number}; without a number an id that is a hash of the natural key."""
    n = normalize_number(number)
    code = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TYPE_CODES.items() for x in kv]), kind), F.lit("VB"))
    own = F.nullif(F.regexp_extract(n, r"/((?:19|20)[0-9]{2})/", 1), F.lit(""))
    when = F.coalesce(own, F.substring(issued.cast("string"), 1, 4), F.lit(str(year)) if year else F.date_format(F.current_date(), "yyyy"))
    return F.when(F.coalesce(n, F.lit("")) == "", F.concat(F.lit("VN:UNRESOLVED:"), F.sha2(natural_key, 256))).otherwise(
        F.concat_ws(":", F.lit("VN"), code, when, F.replace(n, F.lit("/"), F.lit("-"))))


def title_fingerprint(c: Column) -> Column:
    """F14."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(composed(c)), r"[^\p{L}\p{N}\s]", " "), r"(?U)\s+", " "))


def normalized_text(c: Column) -> Column:
    """F16: composed, lower case, single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(composed(c)), r"(?U)\s+", " "))


def sha256(c: Column) -> Column:
    """F15."""
    return F.sha2(c, 256)


def object_hash(entries: Column) -> Column:
    """hash of a map's JSON with sorted keys."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries)))), 256)


def extract_year(number: Column, issued: Column, published: Column) -> Column:
    """F18."""
    part = lambda p: F.nullif(F.regexp_extract(F.coalesce(number, F.lit("")), p, 1), F.lit(""))
    return F.coalesce(F.substring(issued.cast("string"), 1, 4), F.substring(published.cast("string"), 1, 4),
                      part(r"/([0-9]{4})/"), part(r"[-_]([0-9]{4})[-_]"), F.lit("UNKNOWN"))


def strip_tags(html: Column) -> Column:
    """tags to spaces, entities decoded (numeric ones, then named ones), white space squeezed."""
    return F.trim(F.regexp_replace(decode_entities(F.regexp_replace(html, r"<[^>]*>", " ")), r"(?U)\s+", " "))


def query_terms(c: Column, longer_than: int = 1) -> Column:
    """runs of letters and digits in lower case, repeats included; all other characters only part them."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: F.length(x) > longer_than)


def tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != ""))


def snippet(article: Column, heading: Column, content: Column, n: int = 200) -> Column:
    """F24."""
    head = F.when(F.coalesce(heading, F.lit("")) != "", F.concat(F.lit(" - "), heading)).otherwise("")
    return F.concat(F.lit("["), F.coalesce(article, F.lit("Điều")), head, F.lit("] "), F.substring(content, 1, n), F.lit("..."))


def next_retry(attempt: Column, key: Column, now: Column) -> Column:
    """6, 24 or 72 hours after now by attempt, with up to 20 % either way by a hash of the key."""
    base = F.element_at(F.array(*[F.lit(h) for h in RETRY_HOURS]), F.least(F.greatest(attempt, F.lit(1)), F.lit(len(RETRY_HOURS))).cast("int"))
    u = F.pmod(F.xxhash64(key, attempt), F.lit(10_001)) / 10_000.0
    return (now.cast("timestamp") + F.make_dt_interval(secs=(base * 3600 * (1 + (2 * u - 1) * 0.2)).cast("decimal(18,6)")))


def backfill_date(issued: Column, evidence: Column, title: Column, default_year: int) -> tuple[Column, Column]:
    """(date, imputed): the given date, evidence, a year in the title, else a default that is marked imputed."""
    year = F.coalesce(F.nullif(F.regexp_extract(title, r"(?iu)năm\s+((?:19|20)[0-9]{2})", 1), F.lit("")),
                      F.nullif(F.regexp_extract(title, r"((?:19|20)[0-9]{2})", 1), F.lit("")))
    known = F.coalesce(issued, evidence)
    guess = F.coalesce(F.to_date(F.concat(year, F.lit("-01-01"))), F.lit(f"{default_year}-01-01").cast("date"))
    return F.coalesce(known, guess), known.isNull()


def metadata(title: Column, text: Column) -> Column:
    """F11."""
    kind = document_type(title, text)
    return F.struct(
        document_number(title, text).alias("document_number"), kind.alias("document_type"), document_nature(title, kind, text).alias("document_nature"),
        F.trim(title).alias("title"), issuer(title).alias("issuer_name"),
        vn_date(F.concat(title, F.lit(" "), F.substring(F.coalesce(text, F.lit("")), 1, 1500))).alias("issued_date"),
        effective_from(F.coalesce(text, F.lit(""))).alias("effective_from"),
        topics(F.concat_ws(" ", title, text)).alias("topics"))
