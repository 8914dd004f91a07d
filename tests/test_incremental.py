"""Runs that go on from earlier ones: nothing is lost or doubled, and only what changed is worked on."""

import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from lexepoch.operators import intake, verify
from lexepoch.plans import incremental_queries as Q
from lexepoch.sources import tables as X
from lexepoch.sources.ledger import Ledger
from lexepoch.streaming import streams


@pytest.fixture
def ledger(spark, tmp_path):
    return Ledger(spark, str(tmp_path / "t"), {"a": "k long, v string", "b": "n int"})


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_what_a_lost_run_wrote_is_not_seen_and_the_next_attempt_counts(spark, ledger):
    made = {"a": spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string"), "b": spark.createDataFrame([(7,)], "n int")}

    def lost():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        ledger.run(0, lambda: made, lost)
    assert rows(ledger.table("a")) == [] and not ledger.done(0)
    assert ledger.run(0, lambda: made)
    assert rows(ledger.table("a")) == [(1, "x"), (2, "y")] and rows(ledger.table("b")) == [(7,)]
    assert not ledger.run(0, lambda: pytest.fail("a batch that is done is not built again"))
    assert rows(ledger.table("a")) == [(1, "x"), (2, "y")]


def test_half_a_ledger_row_is_no_row(spark, ledger, tmp_path):
    """A run lost while it wrote its row leaves a folder; the batch can still be done."""
    (tmp_path / "t" / "ledger" / "batch_id=3" / "_temporary" / "0").mkdir(parents=True)
    assert not ledger.done(3)
    assert ledger.run(3, lambda: {"b": spark.createDataFrame([(1,)], "n int")})
    assert rows(ledger.table("b")) == [(1,)]


def test_latest_and_state(spark, ledger):
    frame = lambda *r: {"a": spark.createDataFrame(list(r), "k long, v string")}
    assert rows(ledger.state("a")) == []
    ledger.run(0, lambda: frame((1, "x"), (2, "y")))
    ledger.run(1, lambda: frame((1, None)))
    ledger.run(2, lambda: {"b": spark.createDataFrame([(1,)], "n int")})
    assert rows(ledger.latest("a", ["k"])) == [(1, None), (2, "y")]
    assert rows(ledger.state("a")) == [(1, None)]
    assert rows(Ledger(spark, ledger.path, {"a": "k long, v string"}).table("a")) == rows(ledger.table("a"))


def items(spark, given):
    return spark.createDataFrame([(s, u, i, d and dt.date.fromisoformat(d), h) for s, u, i, d, h in given], intake.ITEM)


def test_intake_after_two_days_down_and_after_a_lost_run(spark, tmp_path):
    ledger, path = intake.open_ledger(spark, str(tmp_path / "t")), str(tmp_path / "in")
    fail = []

    def lost(number):
        if number == 1 and not fail:
            fail.append(1)
            raise RuntimeError("lost")

    def land(*given):
        items(spark, given).write.mode("append").parquet(path)
        for _ in range(2):
            try:
                return streams.intake_run(streams.intake(spark, path, intake.ITEM), ledger, str(tmp_path / "c"), before_commit=lost)
            except StreamingQueryException:
                assert rows(ledger.state("marks")) == [("feed", dt.date(2026, 9, 4), 100)]

    land(("feed", "u0", 100, "2026-09-04", "h0"))
    land(*[("feed", f"u{i}", 100 + i, f"2026-09-0{4 + i // 3}", f"h{i}") for i in range(1, 6)], ("feed", "u9", 99, "2026-09-03", "late"), ("feed", "u8", 98, None, "undated"))
    assert rows(ledger.state("marks")) == [("feed", dt.date(2026, 9, 5), 105)]
    assert sorted(r.item_id for r in ledger.table("items").collect()) == [98, *range(100, 106)]
    # The same item again: no second source, no second snapshot; the same page under another hash: one more version.
    land(("feed", "u5", 105, "2026-09-05", "h5"), ("feed", "u4", 106, "2026-09-06", "h4b"))
    assert ledger.table("sources").count() == 7
    assert sorted((r.snapshot_id, r.version) for r in ledger.table("snapshots").collect()) == [(98, 1), *((i, 1) for i in range(100, 106)), (106, 2)]


def test_forced_intake_takes_late_items_and_keeps_the_mark(spark, tmp_path):
    ledger = intake.open_ledger(spark, str(tmp_path / "t"))
    ledger.run(0, lambda: intake.build(ledger, items(spark, [("s", "u", 1, "2024-05-01", "a")])))
    ledger.run(1, lambda: intake.build(ledger, items(spark, [("s", "u", 2, "2024-04-01", "b")]), force=True))
    ledger.run(2, lambda: intake.build(ledger, items(spark, [])))
    assert rows(ledger.state("marks")) == [("s", dt.date(2024, 5, 1), 1)]
    assert ledger.table("items").count() == 2


def test_drift_lanes_of_a_repeated_batch(spark, tmp_path):
    given = [(i, "good" if i % 2 else "bad", str(i), "t", "2024-01-01" if i % 2 else None, "x") for i in range(60)]
    schema = "doc_id long, source string, document_number string, title string, effective_date string, issuer string"
    ledger = Ledger(spark, str(tmp_path / "t"), {"written": schema, "diverted": schema})
    batch = spark.createDataFrame(given, schema)
    with pytest.raises(RuntimeError):
        ledger.run(0, lambda: intake.drift_lanes(batch, "source"), lambda: (_ for _ in ()).throw(RuntimeError()))
    sink = ledger.sink(lambda b: intake.drift_lanes(b, "source"))
    for _ in range(2):
        sink(batch, 0)
    assert {r.source for r in ledger.table("written").collect()} == {"good"} and ledger.table("written").count() == ledger.table("diverted").count() == 30


def test_only_touched_documents_are_verified_again_and_the_result_is_that_of_a_full_run(spark, sf_dir, tmp_path):
    docs = X.x_docs(spark, sf_dir)
    before, (srcs, snaps, evidence) = Q._snapshots(spark, sf_dir, "FALSE"), Q._snapshots(spark, sf_dir, "supp % 5 = 0")
    two = Ledger(spark, str(tmp_path / "two"), verify.LEDGER)
    verify.reverify(two, 0, docs, *before)
    changed = snaps.where("snapshot_id % 10 = 2")
    verify.reverify(two, 1, docs, srcs, snaps, evidence, changed)
    once = rows(verify.corpus(docs, srcs, evidence, snaps))
    assert rows(verify.verdicts_now(two)) == once
    again = spark.read.parquet(f"{two.path}/verdicts").where("batch_id = 1").select("document_id")
    ids = {r.document_id for r in verify.touched(srcs, changed).collect()}
    assert sorted(r.document_id for r in again.collect()) == sorted(ids) and 0 < len(ids) < docs.count()
    # Once more with nothing new: the same verdicts, no conflict is recorded twice.
    n = two.table("conflicts").count()
    verify.reverify(two, 2, docs, srcs, snaps, evidence, changed)
    assert two.table("conflicts").count() == n and rows(verify.verdicts_now(two)) == once
    verify.reverify(two, 3, docs, srcs, snaps, evidence, changed.limit(0))
    assert rows(verify.verdicts_now(two)) == once


def test_superseded_evidence_is_silent_and_fixtures_too(spark):
    docs = spark.createDataFrame([(1, "1/2020", "2020-01-01", "2020-02-01", None)], "document_id long, document_number string, issued_date string, effective_from string, effective_to string")
    srcs = spark.createDataFrame([(1, 10, "tier_a", 102), (1, 11, "tier_a", None)], "document_id long, source_id long, source_authority string, current_snapshot_id long")
    snaps = spark.createDataFrame([(10, 101, True, "2024-01-01"), (10, 102, False, "2024-01-02"), (11, 111, False, "2024-01-01"), (11, 112, False, "2024-01-03")],
                                  "source_id long, snapshot_id long, is_current boolean, fetched_at string")
    said = [(101, "2020-03-01", None, None), (102, "2020-02-01", None, None), (111, "2020-04-01", None, None), (112, "2020-02-01", None, None), (112, "2020-05-01", '{"is_fixture": true}', None),
            (112, "2020-05-01", '{"quarantined": true}', None), (112, "2020-05-01", '{"evidence_origin": "test_fixture"}', None), (112, "2020-05-01", None, "test_fixture"), (112, "2020-05-01", None, "synthetic_test")]
    evidence = spark.createDataFrame([(1, s, "effective_from", v, i, loc, kind, False, "production", "live_official") for i, (s, v, loc, kind) in enumerate(said[::-1])],
                                     "document_id long, snapshot_id long, field_name string, asserted_value string, evidence_id int, evidence_locator string, evidence_type string, is_quarantined boolean, environment string, evidence_origin string")
    got = verify.corpus(docs, srcs, evidence, snaps).first()
    assert (got.n_conflicts, got.status, got.answerable) == (0, "cross_verified", True)
    old = srcs.withColumn("current_snapshot_id", F.when(F.col("source_id") == 10, F.lit(101)))
    assert verify.corpus(docs, old, evidence, snaps).first().status == "conflicting"
