"""State that streams carry between batches, tables replaced in parts, comparisons by hashes, pointers away from what is quarantined."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from lexepoch.functions import text as T
from lexepoch.operators import snapshots, versions
from lexepoch.sources import sinks
from lexepoch.streaming import streams


def ts(text):
    return dt.datetime.fromisoformat(text)


def landed(spark, tmp_path, batches, schema, stream, name="q"):
    """Rows that a stream gives for landings one after the other, each run starting anew from the checkpoint."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"{name}-in"))
        with streams.with_rocksdb(spark):
            streams.run(stream(streams.intake(spark, str(tmp_path / f"{name}-in"), schema)), str(tmp_path / f"{name}-c"), path=str(tmp_path / f"{name}-out"))
    return spark.read.parquet(str(tmp_path / f"{name}-out"))


def test_alerts_go_on_over_batches_and_empty_hours(spark, tmp_path):
    hour = lambda h, n: [("a", ts("2024-01-01T00:00:00") + dt.timedelta(hours=h, minutes=i)) for i in range(n)]
    batches = [hour(0, 4) + hour(1, 2), hour(1, 1) + hour(5, 20), hour(9, 1) + [("b", ts("2024-01-01T09:30:00"))], hour(12, 1)]
    out = landed(spark, tmp_path, batches, "event_type string, ts timestamp", lambda s: streams.stream_alerts(s, back=3))
    got = [(r.window_start.hour, r.n, r.trailing_mean, r.alert) for r in out.where("event_type = 'a'").orderBy("window_start").collect()]
    counts = [4, 3, 0, 0, 0, 20, 0, 0, 0, 1, 0]
    want = []
    for h, n in enumerate(counts):
        past = counts[max(0, h - 3):h]
        mean = round(sum(past) / len(past), 6) if past else None
        want.append((h, n, mean, mean is not None and n > 2 * mean))
    assert got == want and [h for h, *_, a in got if a] == [5, 9]
    assert [(r.window_start.hour, r.n) for r in out.where("event_type = 'b'").orderBy("window_start").collect()] == [(9, 1), (10, 0)]


def test_leases_end_by_themselves_and_three_attempts_are_the_last(spark, tmp_path):
    m = lambda at, kind, item=1: (item, ts(f"2024-01-{at}"), kind)
    batches = [[m("01T00:00", "claim"), m("01T00:10", "claim"), m("01T00:00", "claim", 2), m("01T00:20", "success", 2)],
               [m("01T03:00", "claim"), m("01T05:00", "failure", 2)], [m("01T07:30", "claim"), m("01T08:00", "failure")],
               [m("02T08:30", "claim"), m("02T08:40", "claim", 3)], [m("09T00:00", "claim", 4)], [m("20T00:00", "claim", 5)]]
    out = landed(spark, tmp_path, batches, "item_id long, ts timestamp, kind string", lambda s: streams.retry_queue(s, "1 hour", delay="1 minute"))
    log = [(r.change, r.state, r.attempts, str(r.next_retry_at)[5:16]) for r in out.where("item_id = 1").orderBy("at", "attempts", F.col("lease_until").isNotNull()).collect()]
    assert log == [("queued", "waiting", 0, "01-01 00:00"), ("claimed", "waiting", 0, "01-01 00:00"), ("lease expired", "waiting", 1, "01-01 07:00"), ("claimed", "waiting", 1, "01-01 07:00"),
                   ("failure", "waiting", 2, "01-02 08:00"), ("claimed", "waiting", 2, "01-02 08:00"), ("lease expired", "failed", 3, "01-02 09:30")]
    assert [(r.change, r.state) for r in out.where("item_id = 2").orderBy("at", F.col("lease_until").isNotNull()).collect()] == [("queued", "waiting"), ("claimed", "waiting"), ("success", "done")]
    assert [r.change for r in out.where("item_id = 3 AND change = 'lease expired'").collect()] == ["lease expired"]


def test_a_null_hash_keeps_the_old_one(spark, tmp_path):
    schema = "source_id long, version int, page_hash string, text_hash string, metadata_hash string"
    batches = [[(1, 1, "a", "t", None), (2, 1, None, None, None)], [(1, 2, None, "t", None), (1, 3, "a", None, "m"), (2, 2, None, "x", None)], [(1, 4, "a", "u", "m"), (1, 5, "a", "u", "m"), (1, 6, "b", None, None)]]
    out = landed(spark, tmp_path, batches, schema, streams.snapshot_changes)
    assert sorted((r.source_id, r.version, r.change) for r in out.collect()) == [(1, 1, "CREATED"), (1, 3, "CHANGED"), (1, 4, "CHANGED"), (1, 6, "CHANGED"), (2, 2, "CREATED")]
    log = spark.createDataFrame([r for b in batches for r in b], schema)
    batch = snapshots.changes(log).where("change <> 'UNCHANGED' AND NOT (source_id = 2 AND version = 1)").select("source_id", "version").collect()
    assert sorted(map(tuple, batch)) == [(1, 1), (1, 3), (1, 4), (1, 6), (2, 2)]


def test_sources_share_states_of_a_fixed_number(spark, tmp_path):
    schema = "source_id long, version int, page_hash string, text_hash string"
    batches = [[(i, 1, f"p{i % 7}", None if i % 3 else "t") for i in range(120)],
               [(i, 2, f"p{i % 5}", "t") for i in range(60, 180)],
               [(i, 3, None, "u" if i % 10 == 0 else None) for i in range(0, 180, 2)] + [(i, 4, None, "t") for i in range(0, 180, 20)]]
    out = landed(spark, tmp_path, batches, schema, lambda s: streams.snapshot_changes(s, buckets=4), "b")
    last, want = {}, []
    for source, version, *hashes in (r for b in batches for r in b):
        old = last.get(source, [None, None])
        new = [h or o for h, o in zip(hashes, old)]
        if new != old:
            want.append((source, version, "CHANGED" if source in last else "CREATED"))
            last[source] = new
    assert sorted((r.source_id, r.version, r.change) for r in out.collect()) == sorted(want)
    with streams.with_rocksdb(spark):
        state = spark.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / "b-c"))
        assert state.count() <= 4


def test_three_hashes_and_pointers(spark):
    v = spark.createDataFrame([(1, 1, 10, "Thuế  A", {"b": "1", "a": "2"}), (1, 2, 11, "thuế a", {"a": "2", "b": "1"}), (2, 1, 20, None, None)], "source_id long, version int, snapshot_id long, text string, metadata map<string,string>")
    h = {r.snapshot_id: r for r in snapshots.hashed(v).collect()}
    assert h[10].page_hash != h[11].page_hash and h[10].text_hash == h[11].text_hash and h[10].metadata_hash == h[11].metadata_hash and h[20].metadata_hash is None
    srcs = spark.createDataFrame([(1,), (3,)], "source_id long")
    assert sorted(map(tuple, snapshots.pointers(srcs, v).collect())) == [(1, 11), (3, None)]
    assert T  # functions under test are reached through snapshots


def test_sources_point_away_from_quarantined_snapshots(spark):
    srcs = spark.createDataFrame([(1, 12, "x"), (2, 20, "y"), (3, 30, "z"), (4, None, "w")], "source_id long, current_snapshot_id long, url string")
    snaps = spark.createDataFrame([(1, 10, "2024-01-01"), (1, 11, "2024-01-02"), (1, 12, "2024-01-03"), (2, 20, "2024-01-01"), (3, 30, "2024-01-01"), (3, 31, "2024-01-09")], "source_id long, snapshot_id long, fetched_at string")
    evidence = spark.createDataFrame([(12, True), (11, True), (20, True), (30, False), (31, None)], "snapshot_id long, is_quarantined boolean")
    got = sorted((r.source_id, r.current_snapshot_id, r.url) for r in snapshots.repoint(srcs, snaps, evidence).collect())
    assert got == [(1, 10, "x"), (2, None, "y"), (3, 30, "z"), (4, None, "w")]


def test_only_parts_with_replaced_parents_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(400).select((F.col("id") % 100).alias("document_id"), F.col("id").alias("provision_id"), F.lit("old").alias("content"))
    sinks.write_parts(rows, path, "document_id", 16)
    files = lambda: {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    before, new = files(), spark.createDataFrame([(5, 1000, "new"), (5, 1001, "new"), (7, 1002, "new"), (777, 1003, "new")], "document_id long, provision_id long, content string")
    for _ in range(2):  # once more gives the same
        sinks.replace_parts(new, path, "document_id", 16)
        table = spark.read.parquet(path)
        assert table.where("document_id NOT IN (5, 7, 777)").count() == 392 and table.where("content = 'new'").count() == 4 and table.count() == 396
    kept = before & files()
    assert len(before) - len(kept) <= 3 and kept
    sinks.replace_parts(new.limit(0), path, "document_id", 16)
    assert spark.read.parquet(path).count() == 396


@pytest.mark.parametrize("buckets", [1, 7, 4096])
def test_versions_compared_by_hashes_equal_multisets(spark, buckets):
    from collections import Counter
    a = [("x", None), (None, "x"), ("y", "1"), ("y", "1"), ("z", "2"), (None, None)]
    b = [(None, "x"), (None, "x"), ("y", "1"), ("z", "3"), (None, None)]
    frame = lambda r: spark.createDataFrame(r, "p string, q string")
    got = snapshots.compare_versions(frame(a), frame(b), buckets).first()
    assert tuple(got) == (6, 5, sum((Counter(a) - Counter(b)).values()), sum((Counter(b) - Counter(a)).values()), False)
    assert tuple(snapshots.compare_versions(frame(a), frame(a[::-1]), buckets).first()) == (6, 6, 0, 0, True)
    assert tuple(snapshots.compare_versions(frame([]), frame([]), buckets).first()) == (0, 0, 0, 0, True)


def test_what_became_of_unknown_content_is_unknown(spark):
    day = dt.date
    rows = [(1, 1, "Điều 1", None, "a", None, None), (2, 1, "Điều 2", None, None, None, None), (3, 1, "Điều 3", None, None, day(2020, 1, 1), None), (4, 1, "Điều 4", None, None, None, day(2019, 1, 1))]
    p = spark.createDataFrame(rows, "provision_id long, document_id long, article string, clause string, content string, valid_from date, valid_to date")
    got = {r.article: r.change for r in versions.compare(p, "2018-01-01", "2021-01-01").collect()}
    assert got == {"Điều 1": "UNCHANGED", "Điều 2": "UNKNOWN", "Điều 3": "ADDED", "Điều 4": "REMOVED"}
