"""Composed and decomposed letters, numeric references, terms, numbers, and edges of lines with several targets."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexepoch.functions import text as T
from lexepoch.operators import audit, search, segment
from lexepoch.sources import landed


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(f(F.col("t")).alias("x")).first().x


def test_composed_equals_nfc_on_latin_letters(spark):
    rng = random.Random(1)
    letters = [c for c in map(chr, (*range(0x41, 0x7B), *range(0xC0, 0x250), *range(0x1E00, 0x1F00))) if unicodedata.normalize("NFD", c)[1:].strip(T.MARKS) == ""]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(150)] + ["Thuế giá trị gia tăng", "Điều 1. Ưu đãi", "", "́a", "x́", "日本"]
    rows = [(i, unicodedata.normalize("NFD", t) if i % 3 else t) for i, t in enumerate(texts)] + [(999, None)]
    rows += [(1000 + i, a + "".join(m)) for i, (a, m) in enumerate([("e", "̣̂"), ("e", "̣̂"), ("ê", "̣"), ("o", "̛̣"), ("ẹ", "̂"), ("u", "̛́"), ("a", "̆̃")])]
    df = spark.createDataFrame(rows, "i int, t string")
    for r in df.select("t", T.composed(F.col("t")).alias("c")).collect():
        assert r.c == (r.t and unicodedata.normalize("NFC", r.t))


def test_decomposed_input_gives_what_composed_input_gives(spark):
    d = lambda s: unicodedata.normalize("NFD", s)
    assert one(spark, d("Thuế GTGT, ngày"), T.title_fingerprint) == "thuế gtgt ngày"
    assert one(spark, d("Thuế  Ở đây "), T.normalized_text) == "thuế ở đây"
    assert one(spark, d("15–2022/NĐ-CP ế"), T.normalize_number) == "15-2022/ND-CPE"
    docs = spark.createDataFrame([(1, d("Chương I\nĐiều 1. Phạm vi\n1. Khoản một\nBãi bỏ Nghị định số 7/2003/NĐ-CP"))], "document_id long, text string")
    assert sorted(r.article for r in segment.provisions(docs).collect()) == ["Điều 1", "Điều 1"]
    assert [r.target_number for r in segment.relationships(docs).collect()] == ["7/2003/ND-CP"]


@pytest.mark.parametrize("coded, want", [
    ("Ngh&#225; &#x1F600;&#128512;", "Nghá 😀😀"), ("&#xD800; &#99999999999; &#x110000;", "&#xD800; &#99999999999; &#x110000;"), ("a&#38;#65;", "a&#65;"), ("&#x26;#65;", "A"),
    ("&amp;#65;", "&#65;"), ("&#65", "&#65"), ("&#0065;&#x00041;", "AA"), ("", ""), (None, None), ("&lt;&quot;&nbsp;&#160;", "<\" \xa0")])
def test_references(spark, coded, want):
    assert one(spark, coded, T.decode_entities) == want


def test_references_inside_pages(spark):
    html = "<h1>V&#259;n b&#x1EA3;n | x</h1><table><tr><td>S&#7889; k&yacute;</td><td>1</td></tr><tr><td>Cơ quan ban h&#224;nh</td><td>B&#7897; <b>T&#xE0;i</b> ch&#237;nh</td></tr></table><a href='/v/1.html'>Ngh&#7883; <i>&#273;&#7883;nh</i></a>"
    pages = spark.createDataFrame([(1, "https://x.org/a", html)], "page_id long, url string, html string")
    assert T and landed.listing_links(pages, r"/v/[^\"']+", "https://x.org").first().title == "Nghị định"
    got = landed.html_properties(pages, {"issuer": ("cơ quan ban hành",)}).first()
    assert got.issuer == "Bộ Tài chính" and got.title == "Văn bản"


@pytest.mark.parametrize("text, terms", [
    ("VAT, rate? 12/1996/NĐ-CP", ["vat", "rate", "12", "1996", "nđ", "cp"]), ("a b cd", ["cd"]), ("thuế thuế!", ["thuế", "thuế"]), ("...", []), ("", []), (" x_y zz ", ["zz"])])
def test_terms_are_parted_by_all_signs(spark, text, terms):
    assert one(spark, text, T.query_terms) == terms


def test_terms_of_a_question_with_signs_score(spark):
    row = spark.createDataFrame([("the vat rate", "rates", "vat, rate?")], "c string, h string, q string")
    score = search.provision_score(F.col("c"), F.col("h"), T.query_terms(F.col("q")), F.lower("q"), F.lit(False))
    assert row.select(score.alias("s")).first().s == pytest.approx(0.5 + 0.5 + 0.8)


def test_number_begins_with_a_digit_in_title_and_text(spark):
    df = spark.createDataFrame([("Về việc", "Số: abc\nSố: 7/2020/TT-BTC")], "t string, b string")
    assert df.select(T.document_number(F.col("t"), F.col("b")).alias("n")).first().n == "7/2020/TT-BTC"
    assert df.select(T.document_number(F.col("t"), F.col("b"), strict_parity=True).alias("n")).first().n == "abc"


EDGES = [
    ("Bãi bỏ Nghị định số 1/2000/NĐ-CP và Nghị định số 2/2001/NĐ-CP", [("repeals", "1/2000/ND-CP", None, None), ("repeals", "2/2001/ND-CP", None, None)]),
    ("Bãi bỏ khoản 2 Điều 5 của Nghị định số 7/2003/NĐ-CP, Điều 3 Thông tư 8/2004/TT-BTC và Luật số 9/2005/QH11",
     [("partially_repeals", "7/2003/ND-CP", "Điều 5", "2"), ("partially_repeals", "8/2004/TT-BTC", "Điều 3", None), ("repeals", "9/2005/QH11", None, None)]),
    ("Sửa đổi, bổ sung một số điều của Nghị định số 1/2000/NĐ-CP; thay thế Thông tư số 3/2002/TT-BTC, số 4/2002/TT-BTC",
     [("amends", "1/2000/ND-CP", None, None), ("replaces", "3/2002/TT-BTC", None, None), ("replaces", "4/2002/TT-BTC", None, None)]),
    ("Bãi bỏ một phần Nghị định số 1/2000/NĐ-CP", []), ("Căn cứ Nghị định số 6/2000/NĐ-CP", []), ("Hướng dẫn Quyết định số 5/2000/QĐ-TTg", []),
    ("Hướng dẫn thi hành Nghị định số 5/2000/NĐ-CP", [("guides", "5/2000/ND-CP", None, None)]),
    ("bãi bỏ điều 4 luật quản lý thuế số 38/2019/QH14", [("partially_repeals", "38/2019/QH14", "Điều 4", None)]),
    ("Bãi bỏ Nghị định số 1/2000/NĐ-CP ngày 3 tháng 4 năm 2000 của Chính phủ và Nghị định số 2/2001/NĐ-CP", [("repeals", "1/2000/ND-CP", None, None), ("repeals", "2/2001/ND-CP", None, None)]),
    ("", []), (None, [])]


def test_every_target_of_a_line_goes_to_the_verb_before_it(spark):
    docs = spark.createDataFrame([(i, line) for i, (line, _) in enumerate(EDGES)], "document_id long, text string")
    got = {}
    for r in segment.relationships(docs).collect():
        got.setdefault(r.document_id, []).append((r.relationship_type, r.target_number, r.target_article, r.target_clause))
    assert got == {i: want for i, (_, want) in enumerate(EDGES) if want}
    first = {r.document_id: r.relationship_type for r in segment.relationships(docs, first_only=True).collect()}
    assert first == {0: "repeals", 1: "partially_repeals", 2: "replaces", 6: "guides", 7: "partially_repeals", 8: "repeals"}


def test_an_empty_batch_is_degraded(spark):
    none = spark.createDataFrame([], "source string, document_number string, title string, effective_date string, issuer string")
    got = audit.drift(none, None).first()
    assert (got.total, got.extraction_rate, got.flags, got.circuit) == (0, 0.0, "NO_SAMPLES_EVALUATED", "DEGRADED")
    assert audit.drift(none, "source").count() == 0
    some = spark.createDataFrame([("s", str(i), "t", "2024", "i") for i in range(10)], none.schema)
    assert audit.drift(some, None).first().circuit == "HEALTHY"
    listed = spark.createDataFrame([("s",), ("gone",), (None,)], "source string")
    assert {(r.source, r.circuit, r.flags) for r in audit.drift(some, "source", expected=listed).collect()} == {
        ("s", "HEALTHY", ""), ("gone", "DEGRADED", "NO_SAMPLES_EVALUATED"), (None, "DEGRADED", "NO_SAMPLES_EVALUATED")}


def test_long_documents_give_the_same_rows_in_chunks(spark):
    rng = random.Random(6)
    lines = ["Chương I", "Mục 2", "Điều 1. Một", "Điều 15a", "1. Khoản một", "Khoản 2. Hai", "3. có hiệu lực từ ngày 1 tháng 1 năm 2026", "chữ", "  ", "bãi bỏ từ ngày 2/3/2027", "Điều 3: Ba"]
    docs = spark.createDataFrame([(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 40)))) for i in range(80)] + [(900, "chữ\nchữ"), (901, ""), (902, None), (903, "Điều 1\nx")],
                                 "document_id long, text string")
    want = sorted(map(str, segment.provisions(docs).collect()))
    for long, chunk in ((0, 1), (0, 3), (15, 7)):
        assert sorted(map(str, segment.provisions(docs, long=long, chunk=chunk).collect())) == want
    assert len({r.document_id for r in segment.provisions(docs).collect()}) == 82


def test_a_document_of_very_many_lines_is_many_tasks(spark):
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda i: F.when(i % 50 == 1, F.concat(F.lit("Điều "), i.cast("string"))).otherwise(F.concat((i % 50).cast("string"), F.lit(". khoản")))), "\n")
    docs = spark.range(1).select(F.col("id").alias("document_id"), text.alias("text"))
    chunked = segment.provisions(docs)
    assert chunked.count() == 100_000
    assert chunked.where("clause IS NULL").count() == 2000 and chunked.where("sort_key = '2000.0050'").first().content == "0. khoản"


def _evaluated(df, name):
    """How often the optimised plan works out an expression."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(name)


def test_texts_are_worked_out_once(spark):
    """Filters on what a text gives would move below and work it out again: the plan of plain texts composes and splits each text once, that of long ones once."""
    text = "Mở đầu\n \n Điều 1. Một \n1. a\n\n2. b\r\nChương I\nx\nĐiều 2. Hai\n\t"
    docs = spark.createDataFrame([(1, text), (2, unicodedata.normalize("NFD", text)), (3, " không điều \n"), (4, " \n"), (5, "  "), (6, None)], "document_id long, text string")
    found = segment.provisions(docs).select("document_id", "article", "clause", "content", "sort_key")
    cut = [("Điều 1", None, "Điều 1. Một", "0001.0001"), ("Điều 1", "1", "1. a", "0001.0002"), ("Điều 1", "2", "2. b", "0001.0003"), ("Điều 2", None, "Điều 2. Hai", "0002.0000")]
    want = [(i, *row) for i in (1, 2) for row in cut] + [(3, "Toàn văn", None, "không điều \n", "0001.0000"), (4, "Toàn văn", None, "\n", "0001.0000")]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    for long, chunk in ((1, 1), (3, 2)):
        got = segment.provisions(docs, long=long, chunk=chunk).select("document_id", "article", "clause", "content", "sort_key")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    stored = spark.range(3).selectExpr("id AS document_id", "concat('Điều ', id, '. Một') AS text")
    assert _evaluated(segment.provisions(stored).select("document_id", "content"), r"posexplode(cut") == 1
    assert _evaluated(segment.provisions(stored).select("document_id", "content"), "exists(lines") == 1
