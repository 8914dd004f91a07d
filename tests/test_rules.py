"""Literal cases of the rules, and properties that hold whatever the tables are."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lexepoch.functions import text as T
from lexepoch.operators import audit, canonical, search, segment, snapshots, status, verify, versions
from lexepoch.sources import landed, sinks, tables as X
from lexepoch.sources.scratch import new_path
from lexepoch.streaming import streams

D = dt.date


def one(spark, column, **values):
    names = list(values)
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return row.select(column.alias("x")).first()[0]


@pytest.mark.parametrize("text, want", [
    ("ngày 19 tháng 10 năm 2020", D(2020, 10, 19)), ("19/10/2020", D(2020, 10, 19)), ("Ban hành ngày 01 tháng 07 năm 2022", D(2022, 7, 1)),
    ("NGÀY 5 THÁNG 6 NĂM 2021", D(2021, 6, 5)), ("31/02/2020", None), ("không có", None), (None, None)])
def test_vn_date(spark, text, want):
    assert one(spark, T.vn_date(F.col("t")), t=text) == want


@pytest.mark.parametrize("number, want", [("123/2020/NĐ-CP", "123/2020/ND-CP"), ("15–2022/NĐ-CP", "15-2022/ND-CP"), (" 7 /2021/tt-btc. ", "7/2021/TT-BTC")])
def test_normalize_number(spark, number, want):
    assert one(spark, T.normalize_number(F.col("n")), n=number) == want


def test_canonical_id(spark):
    make = T.canonical_id(F.lit("decree"), F.col("n"), F.lit(None).cast("date"), F.lit("key"), 2024)
    assert one(spark, make, n="123/2020/NĐ-CP") == "VN:ND:2020:123-2020-ND-CP"
    assert one(spark, make, n="9/QĐ") == "VN:ND:2024:9-QD"
    assert one(spark, make, n=None).startswith("VN:UNRESOLVED:")


def test_title_fingerprint_ignores_punctuation(spark):
    assert one(spark, T.title_fingerprint(F.col("t")), t="Nghị định: về  thuế!") == one(spark, T.title_fingerprint(F.col("t")), t="NGHỊ ĐỊNH về thuế")


def test_entities_and_nfc(spark):
    assert one(spark, T.decode_entities(F.col("t")), t="A&#x110;&#65;&amp;lt;&nbsp;") == "AĐA< "
    assert one(spark, T.nfc(F.col("t")), t="é") == "é"


@pytest.mark.parametrize("title, kind, nature", [
    ("Nghị định về hóa đơn", "decree", "normative_legal_document"), ("Dự thảo Nghị định", "decree", "draft"), ("Thông tư hướng dẫn Luật thuế", "law", "normative_legal_document"),
    ("Công văn trả lời", "official_letter", "official_guidance"), ("Quyết định ban hành quy chế", "decision", "normative_legal_document"),
    ("Quyết định khen thưởng", "decision", "administrative_document"), ("Góp ý dự thảo", "other", "consultation"), ("Thông báo", "announcement", "administrative_document")])
def test_type_and_nature(spark, title, kind, nature):
    assert one(spark, T.document_type(F.col("t")), t=title) == kind
    assert one(spark, T.document_nature(F.col("t"), T.document_type(F.col("t"))), t=title) == nature


TEXT = """Chương I
QUY ĐỊNH CHUNG
Điều 1. Phạm vi điều chỉnh
Nghị định này quy định về hóa đơn.
Điều 2. Đối tượng
1. Tổ chức.
Điều 15. Hiệu lực
1. Chung.
2. Khoản này có hiệu lực từ ngày 01/01/2026.
3. Khoản 9 bãi bỏ từ ngày 1 tháng 7 năm 2025."""


def test_segment(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, "Một công văn ngắn."), (3, ""), (4, None)], "document_id long, text string")
    rows = {(r.document_id, r.sort_key): r for r in segment.provisions(docs).collect()}
    assert [k[1] for k in sorted(rows) if k[0] == 1] == ["0001.0000", "0002.0001", "0002.0002", "0003.0001", "0003.0002", "0003.0003", "0003.0004"]
    assert rows[1, "0001.0000"].chapter == "Chương I" and rows[1, "0001.0000"].heading == "Phạm vi điều chỉnh"
    assert rows[1, "0003.0003"].clause == "2" and rows[1, "0003.0003"].valid_from == D(2026, 1, 1)
    assert rows[1, "0003.0004"].valid_to == D(2025, 7, 1) and rows[1, "0003.0004"].status_override == "repealed"
    assert rows[2, "0001.0000"].article == "Toàn văn" and not any(k[0] in (3, 4) for k in rows)


def test_relationships(spark):
    text = "Bãi bỏ Thông tư số 78/2021/TT-BTC\nBãi bỏ Khoản 2 Điều 10 Thông tư số 111/2013/TT-BTC\nThay thế Nghị định số 51/2010/NĐ-CP\nSửa đổi, bổ sung một số điều của Nghị định số 123/2020/NĐ-CP\nHướng dẫn thi hành Nghị định số 123/2020/NĐ-CP\nkhông"
    rows = segment.relationships(spark.createDataFrame([(1, text)], "document_id long, text string")).orderBy("line_no").collect()
    assert [(r.relationship_type, r.target_number) for r in rows] == [
        ("repeals", "78/2021/TT-BTC"), ("partially_repeals", "111/2013/TT-BTC"), ("replaces", "51/2010/ND-CP"), ("amends", "123/2020/ND-CP"), ("guides", "123/2020/ND-CP")]
    assert (rows[1].target_article, rows[1].target_clause) == ("Điều 10", "2")


def _docs(spark, *rows):
    return spark.createDataFrame(list(rows), "document_id long, document_nature string, effective_from date, effective_to date")


def _rels(spark, *rows):
    return spark.createDataFrame(list(rows), "relationship_id long, source_document_id long, target_document_id long, relationship_type string, effective_from date, effective_to date, target_article string, target_clause string")


def test_status_precedence_and_closed_ends(spark):
    law = "normative_legal_document"
    docs = _docs(spark, (1, law, D(2020, 1, 1), D(2020, 12, 31)), (2, "draft", D(2020, 1, 1), None), (3, law, None, None), (4, law, D(2020, 1, 1), None))
    rels = _rels(spark, (1, 9, 4, "partially_repeals", D(2021, 1, 1), None, "Điều 1", "Khoản 2"), (2, 9, 4, "repeals", D(2022, 1, 1), D(2022, 6, 30), None, None))
    got = {(r.document_id, str(r.as_of)): r.status for r in status.documents_at(docs, rels, ["2019-12-31", "2020-12-31", "2021-01-01", "2022-06-30", "2022-07-01"]).collect()}
    assert got[1, "2020-12-31"] == "effective" and got[1, "2021-01-01"] == "expired" and got[1, "2019-12-31"] == "not_yet_effective"
    assert got[2, "2020-12-31"] == "not_yet_effective" and got[3, "2020-12-31"] == "unknown"
    assert (got[4, "2021-01-01"], got[4, "2022-06-30"], got[4, "2022-07-01"]) == ("partially_effective", "repealed", "partially_effective")


def test_clause_repealed_others_stay(spark):
    docs = _docs(spark, (4, "normative_legal_document", D(2020, 1, 1), None))
    rels = _rels(spark, (1, 9, 4, "partially_repeals", D(2021, 1, 1), None, "Điều 1", "Khoản 2"))
    provs = spark.createDataFrame([(1, 4, "Điều 1", "2", None, None, None), (2, 4, "Điều 1", "3", None, None, None)],
                                  "provision_id long, document_id long, article string, clause string, valid_from date, valid_to date, status_override string")
    when = ["2021-05-01"]
    got = {r.provision_id: r.status for r in status.provisions_at(provs, status.documents_at(docs, rels, when), rels, when).collect()}
    assert got == {1: "repealed", 2: "effective"}


def test_versions(spark):
    provs = spark.createDataFrame([(1, 1, "Điều 15", "1", D(2020, 1, 1), D(2025, 6, 1), "cũ"), (2, 1, "Điều 15", "1", D(2025, 6, 1), None, "mới"), (3, 1, "Điều 2", "1", None, D(2024, 1, 1), "x"), (4, 1, "Điều 3", "1", D(2024, 1, 2), None, "x")],
                                  "provision_id long, document_id long, article string, clause string, valid_from date, valid_to date, content string")
    picked = {(r.article, str(r.as_of)): r.provision_id for r in versions.as_of(provs, ["2023-01-01", "2025-06-01", "2026-09-06"]).collect()}
    assert picked["Điều 15", "2023-01-01"] == 1 and picked["Điều 15", "2025-06-01"] == 2 and picked["Điều 15", "2026-09-06"] == 2
    changes = {(r.article, r.change, r.new_article) for r in versions.compare(provs, "2023-01-01", "2026-01-01").collect()}
    assert changes == {("Điều 15", "MODIFIED", None), ("Điều 2", "RENUMBERED", "Điều 3")}


def _asserts(spark, *rows):
    return spark.createDataFrame(list(rows), "document_id long, source_id long, source_authority string, document_number string, issued_date date, effective_from date, effective_to date")


def test_verdicts(spark):
    a = _asserts(spark, (1, 1, "tier_a", "1/A", D(2020, 1, 1), D(2020, 2, 1), None), (1, 2, "tier_b", "1/A", D(2020, 1, 1), D(2020, 2, 1), None),
                 (2, 1, "tier_a", "2/A", None, None, None), (3, 1, "tier_a", "3/A", None, D(2020, 1, 1), None), (3, 2, "news", "3/A", None, D(2021, 1, 1), None),
                 (4, 1, "tier_a", "4/A", D(2020, 1, 1), D(2020, 2, 1), None), (4, 2, "tier_b", "4/A", D(2020, 1, 2), D(2020, 2, 1), None),
                 (5, 1, "tier_a", "5/A", None, D(2020, 2, 1), None), (5, 2, "tier_b", "5/B", None, D(2020, 2, 1), None))
    got = {r.document_id: (r.status, r.answerable) for r in verify.verdicts(a).collect()}
    assert got == {1: ("cross_verified", True), 2: ("single_source_verified", True), 3: ("cross_verified", True), 4: ("conflicting", False), 5: ("conflicting", False)}


def test_inadmissible_evidence_changes_nothing(spark):
    schema = "document_id long, snapshot_id long, field_name string, asserted_value string, is_quarantined boolean, environment string, evidence_origin string"
    good = [(1, 1, "document_number", "1/A", False, "production", "live_official")]
    bad = [(1, 1, "document_number", "0/X", True, "production", "live_official"), (1, 1, "document_number", "0/X", False, "test", "live_official"), (1, 1, "document_number", "0/X", None, "production", "synthetic_fixture")]
    f = lambda rows: verify.admissible(spark.createDataFrame(rows, schema)).collect()
    assert f(good) == f(good + bad)


def test_dedupe_match(spark):
    schema = "document_number string, issued_date date, text_hash string, title_fp string"
    docs = spark.createDataFrame([(1, "1/A", D(2020, 1, 1), "h1", "t1"), (2, "1/A", None, "h2", "t1"), (3, "9/Z", None, "h3", "z")], "document_id long, " + schema)
    cands = spark.createDataFrame([(10, "1/A", D(2020, 1, 1), "hx", "t1"), (11, "5/Q", None, "h3", "q"), (12, "1/A", None, "hy", "w")], "candidate_id long, " + schema)
    got = {r.candidate_id: (r.document_id, r.score) for r in canonical.match(cands, docs).collect()}
    assert got == {10: (1, 1.0), 11: (3, 0.95)}


def test_snapshots_rerun_adds_nothing(spark):
    log = snapshots.hashed(spark.createDataFrame([(1, 1, 1, "a"), (2, 1, 2, "b")], "source_id long, version int, snapshot_id long, text string"))
    new = snapshots.hashed(spark.createDataFrame([(1, 2, 3, "a"), (2, 2, 4, "c"), (3, 2, 5, "d")], "source_id long, version int, snapshot_id long, text string"))
    append, audit_rows = snapshots.apply(log, new)
    assert {(r.source_id, r.event) for r in audit_rows.collect()} == {(1, "CHECKED"), (2, "SOURCE_CHANGED"), (3, "SOURCE_CREATED")}
    again, _ = snapshots.apply(log.unionByName(append), new)
    assert append.count() == 2 and again.count() == 0


def test_drift(spark):
    rows = [("g", "1", "t", "d", "i")] * 10 + [("b", "1" if n < 3 else None, "t", "d", "i") for n in range(10)]
    got = {r.source: (r.circuit, r.extraction_rate) for r in audit.drift(spark.createDataFrame(rows, "source string, document_number string, title string, effective_date string, issuer string"), "source").collect()}
    assert got == {"g": ("HEALTHY", 100.0), "b": ("DEGRADED", 30.0)}


@pytest.mark.parametrize("url, reason", [
    ("https://congbao.chinhphu.vn/a", None), ("https://sub.mof.gov.vn/a", None), ("https://evilmof.gov.vn/", "NOT_ALLOWED"), ("http://10.0.0.1/", "INTERNAL_ADDRESS"), ("http://[::1]/", "INTERNAL_ADDRESS"),
    ("file:///etc/passwd", "INVALID_URL"), ("https://a:b@mof.gov.vn/", "USERINFO"), ("https://mof.gov.vn:444/", "PORT"), (None, "INVALID_URL")])
def test_admit_urls(spark, url, reason):
    assert landed.admit_urls(spark.createDataFrame([(url,)], "url string")).first().reason == reason


def test_object_key(spark):
    key = landed.object_key(F.lit("VBPL"), F.lit("2026-09-03").cast("date"), F.lit("source-001"), F.lit("snapshot-999"), F.lit("response.xml"))
    assert one(spark, key, n="") == "raw/vbpl/2026/09/source-001/snapshot-999/response.xml"


def test_search_of_punctuation_finds_nothing(spark, sf_dir):
    from lexepoch.sources import tables as X
    q = spark.createDataFrame([(1, "!!"), (2, "hóa đơn")], "query_id int, query string")
    got = search.search(q, X.x_docs(spark, sf_dir), X.x_provs(spark, sf_dir), 5).collect()
    assert {r.query_id for r in got} == {2} and [r.rank for r in got] == [1, 2, 3, 4, 5]


def test_insert_ignore_and_upsert(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    old.write.parquet(path)
    new = spark.createDataFrame([(2, "x"), (3, "c"), (3, "c")], "k int, v string")
    for _ in range(2):
        sinks.insert_ignore(new, path, ["k"])
        assert {tuple(r) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "b"), (3, "c")}
    up = sinks.upserted(spark.createDataFrame([(2, None), (1, "z"), (9, "n")], "k int, v string"), old, ["k"])
    assert {tuple(r) for r in up.collect()} == {(1, "z"), (2, "b"), (9, "n")}


def test_stream_goes_on_after_what_it_has_read(spark, tmp_path):
    landing, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    batch = lambda lo, hi: spark.range(lo, hi).write.mode("append").parquet(landing)
    batch(0, 5)
    for lo, hi in ((5, 8), (8, 8)):
        streams.run(streams.intake(spark, landing, "id long"), mark, path=out)
        if hi > lo:
            batch(lo, hi)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(8))


def test_drift_gate_diverts_the_degraded(spark):
    rows = [("good", "1", "t", "d", "i")] * 12 + [("bad", None, "t", "d", "i")] * 12
    kept, gone = [], []
    streams.drift_gate(spark.createDataFrame(rows, "source string, document_number string, title string, effective_date string, issuer string"), "source",
                       lambda df: kept.extend(df.collect()), lambda df: gone.extend(df.collect()))
    assert {r.source for r in kept} == {"good"} and {r.source for r in gone} == {"bad"}


def test_new_path_is_in_the_shared_folder(spark):
    assert new_path(spark, "a") != new_path(spark, "a")


def test_search_plans_have_no_nested_loop_and_keys_find_the_same(spark, sf_dir, monkeypatch):
    q = spark.createDataFrame([(i, t) for i, t in enumerate(["small ring", "red", "d", "5/", "thuế giá", "ng"])], "query_id int, query string")
    docs, provs, rels = X.x_docs(spark, sf_dir), X.x_provs(spark, sf_dir), X.x_rels(spark, sf_dir)
    found = search.search(q, docs, provs, 50)
    rules = search.effective_rules(q, docs, provs, rels, "2000-07-01", 10)
    for df in (found, rules):
        assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()
    rows = sorted(map(tuple, found.collect()))
    assert {r[0] for r in rows} == set(range(6))
    monkeypatch.setattr(search, "FEW_KEYS", 2)
    monkeypatch.setattr(search._keys_in, "__defaults__", (2,))
    assert sorted(map(tuple, search.search(q, docs, provs, 50).collect())) == rows


def test_headings_score_and_show(spark):
    df = spark.createDataFrame([("a red ring", "Small ring", ["red", "ring"], "small ring"), ("b", None, ["red"], "small ring"), ("small ring", "Small ring", [], "small ring")],
                               "content string, heading string, terms array<string>, q string")
    got = [r.s for r in df.select(search.provision_score(F.col("content"), F.col("heading"), F.col("terms"), F.col("q"), F.lit(False)).alias("s")).collect()]
    assert got == [2.5 + 0.5 + 0.5 + 0.8, 0.0, 3.0]
    long = spark.range(1).select(T.snippet(F.lit("Điều 2"), F.lit("Phạm vi"), F.repeat(F.lit("x"), 300)).alias("s")).first().s
    assert long == "[Điều 2 - Phạm vi] " + "x" * 200 + "..."


def test_snapshots_of_one_batch_are_numbered_and_compared_in_turn(spark):
    log = spark.createDataFrame([(1, 4, 10, "a")], "source_id long, version int, snapshot_id long, text string")
    new = spark.createDataFrame([(1, 1, 11, "b"), (1, 2, 12, "b"), (1, 3, 13, "a"), (2, 1, 14, "z"), (2, 2, 15, "z")], log.schema)
    append, audit_rows = snapshots.apply(snapshots.hashed(log), snapshots.hashed(new))
    assert sorted((r.source_id, r.version, r.snapshot_id) for r in append.collect()) == [(1, 5, 11), (1, 6, 13), (2, 1, 14)]
    assert sorted((r.snapshot_id, r.event) for r in audit_rows.collect()) == [
        (11, "SOURCE_CHANGED"), (12, "CHECKED"), (13, "SOURCE_CHANGED"), (14, "SOURCE_CREATED"), (15, "CHECKED")]


def test_drift_gate_keeps_rows_without_a_group(spark):
    rows = [(None, "1", "t", "2024-01-01", "x")] * 3 + [("a", "1", "t", None, "x")] * 3
    out = {}
    streams.drift_gate(spark.createDataFrame(rows, "source string, document_number string, title string, effective_date string, issuer string"), "source",
                       lambda df: out.update(written=df.count()), lambda df: out.update(diverted=df.count()))
    assert out == {"written": 3, "diverted": 3}


def test_feed_links_are_decoded(spark):
    xml = "<rss><item><title>A &amp; B</title><link>https://x.vn/?a=1&amp;b&#61;2</link></item></rss>"
    r = landed.feed_items(spark.createDataFrame([("s", xml)], "source_name string, xml string")).first()
    assert (r.title, r.url, r.item_id) == ("A & B", "https://x.vn/?a=1&b=2", "https://x.vn/?a=1&b=2")
