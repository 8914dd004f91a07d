"""Rules in force: what makes a question answerable."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lexepoch.operators import search, verify


@pytest.fixture(scope="module")
def world(spark):
    day = dt.date(2000, 1, 1)
    title = {1: "Nghị định về hóa đơn", 2: "Nghị định về hải quan", 3: "Công văn về kế toán", 4: "Nghị định về phí"}
    docs = spark.createDataFrame([(i, f"{i}/2000/NĐ-CP", t, "official_guidance" if i == 3 else "normative_legal_document", day, day, None) for i, t in title.items()],
                                 "document_id long, document_number string, title string, document_nature string, issued_date date, effective_from date, effective_to date")
    provs = spark.createDataFrame([(i * 10, i, "Điều 1", None, f"{t}: " + "chữ " * 100, None, None, None, "0001.0000") for i, t in title.items()],
                                  "provision_id long, document_id long, article string, clause string, content string, valid_from date, valid_to date, status_override string, sort_key string")
    rels = spark.createDataFrame([], "relationship_id long, source_document_id long, target_document_id long, relationship_type string, effective_from date, effective_to date, target_article string, target_clause string")
    said = [(i, s, "tier_a", f"{i}/2000/NĐ-CP", "2000-01-01", "2000-02-01" if (i, s) == (2, 2) else "2000-01-01", None) for i in (1, 2, 3) for s in (1, 2)]
    asserts = spark.createDataFrame(said, "document_id long, source_id long, source_authority string, document_number string, issued_date string, effective_from string, effective_to string")
    evidence = spark.createDataFrame([(1, None, "issued_date"), (2, None, "issued_date"), (3, 30, "content")], "document_id long, provision_id long, field_name string")
    asked = spark.createDataFrame([(1, "hóa đơn"), (2, "hải quan"), (3, "kế toán"), (4, "phí"), (5, "zzz")], "query_id int, query string")
    return docs, provs, rels, asserts, evidence, asked


def test_conflicts_and_missing_evidence_are_no_answers(spark, world):
    docs, provs, rels, asserts, evidence, asked = world
    rules = search.effective_rules(asked, docs, provs, rels, "2001-01-01", 5, evidence, verdicts=verify.verdicts(asserts))
    rows = {r.query_id: r for r in rules.collect()}
    assert (rows[1].n_evidence, rows[1].verification, rows[1].answerable, len(rows[1].snippet)) == (1, "cross_verified", True, 250)
    assert (rows[2].verification, rows[2].answerable) == ("conflicting", False)
    assert (rows[3].lane, rows[3].fields, len(rows[3].snippet), rows[3].answerable) == ("guidance", "content", 300, True)
    assert (rows[4].n_evidence, rows[4].verification, rows[4].answerable) == (0, "unverified", False)
    strict = {r.query_id: (r.answerable, r.code) for r in search.answerability(asked, rules, strict=True).collect()}
    assert strict == {1: (True, None), 2: (False, "SOURCE_CONFLICT"), 3: (True, None), 4: (False, "INSUFFICIENT_EVIDENCE"), 5: (False, "INSUFFICIENT_EVIDENCE")}
    plain = {r.query_id: r.answerable for r in search.answerability(asked, rules).collect()}
    assert plain == {1: True, 2: True, 3: True, 4: True, 5: False}
    unsure = search.effective_rules(asked.where("query_id = 4"), docs, provs, rels, "2001-01-01", 5, evidence.union(spark.createDataFrame([(4, None, "title")], evidence.schema)), verdicts=verify.verdicts(asserts))
    assert search.answerability(asked.where("query_id = 4"), unsure, strict=True).first().code == "VERIFICATION_PENDING"


def test_topics_narrow_rules(spark, world):
    docs, provs, rels, _, evidence, asked = world
    rules = search.effective_rules(asked, docs, provs, rels, "2001-01-01", 5, evidence, topics=["invoice", "customs"])
    assert sorted(r.query_id for r in rules.collect()) == [1, 2]
    assert search.effective_rules(asked.where(F.lit(False)), docs, provs, rels, "2001-01-01", 5, evidence).count() == 0


def test_events_of_a_run_do_not_wait_for_segmentation(spark, sf_dir, monkeypatch):
    from lexepoch.operators import segment
    from lexepoch.plans import corpus

    items = corpus._items(spark, sf_dir).where("document_id < 40")
    want = sorted(map(tuple, corpus.process(items, "2024-06-30")["events"].collect()))
    monkeypatch.setattr(segment, "provisions", lambda docs: pytest.fail("texts were cut"))
    out = corpus.process(items, "2024-06-30", segmented=False)
    assert want and sorted(map(tuple, out["events"].collect())) == want and "provisions" not in out
