"""Changes in several batches and jobs onto a stored table: marks, ids, audit, repeated work."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import NOW
from headgrid.functions.keys import hashed_id, subject_key
from headgrid.operators import scd2
from headgrid.schema import TABLES
from headgrid.sources import publish, tables
from headgrid.streaming import changes as store
from test_replay import feed_of, outcome, replay


@pytest.fixture
def build(changes):
    return lambda feed: changes(*[(q, op, m.isoformat() if isinstance(m, dt.date) else m, s, x) for q, op, m, s, x in feed])


def test_ids_tell_parts_apart(spark):
    pairs = [("a|b", "c"), ("a", "b|c"), (None, "-"), ("-", None), ("", None), (None, ""), ("1:a", ""), ("", "1:a")]
    rows = spark.createDataFrame(pairs, "a string, b string").select(hashed_id("a", "b").alias("id"))
    assert rows.distinct().count() == len(pairs)


@pytest.mark.parametrize("seed, split_rows", [(11, 1_000_000), (12, 25)])
def test_batches_in_any_cut_equal_the_replay(spark, tmp_path, build, seed, split_rows):
    """Cut at random, each batch delivered with part of the one before, and once as a whole again."""
    rng = random.Random(seed)
    feed = feed_of(rng, 260, ["A", "B", "P1", "D"], 0.15, hot="H")
    want, rejected = replay(feed)
    root, at, job = str(tmp_path / "table"), 0, 0
    while at < len(feed):
        until = min(len(feed), at + rng.randint(50, 110))
        batch = build(feed[max(0, at - rng.randint(0, 40)) : until])
        store.apply_change_batch(batch, job, root, buckets=4, split_rows=split_rows)
        at, job = until, job + 1
    store.apply_change_batch(build(feed), "all again", root, buckets=4, split_rows=split_rows)
    entries = store.read_entries(spark, root)
    got, n = outcome(entries)
    assert got == want and n == len(want) == entries.select("id").distinct().count()
    refused = store.read_rejects(spark, root).where("reason <> 'already_delivered'").select(subject_key(), "seq").collect()
    assert {tuple(r) for r in refused} == rejected and len(refused) == len(rejected)
    records = store.read_audit(spark, root)
    counts = {r["action"]: r["count"] for r in records.groupBy("action").count().collect()}
    ended = {"UPDATE": sum(r[2] is not None for r in want), "DELETE": sum(r[3] for r in want)}
    assert counts == {"INSERT": len(want), **{a: n for a, n in ended.items() if n}}
    assert records.select("id").distinct().count() == records.count()
    marks = {r[0]: r[1] for r in store.read_marks(spark, root).select(subject_key(), "last_seq").collect()}
    assert marks == {s: max(q for q, _, _, x, _ in feed if x == s) for s in {f[3] for f in feed}}


def test_a_late_change_is_refused_after_a_delete(spark, tmp_path, build):
    """Without the mark of the deleted subject, change 1 would be stored twice under one id."""
    root = str(tmp_path / "table")
    first = [(1, "set", "2024-01", "A", 1), (2, "delete", "2024-01", "A", 1)]
    store.apply_change_batch(build(first), "a", root, buckets=2)
    store.apply_change_batch(build(first[:1]), "b", root, buckets=2)
    assert store.read_entries(spark, root).count() == 1
    assert [r.reason for r in store.read_rejects(spark, root).collect()] == ["already_delivered"]


def test_one_change_of_a_repeated_number_counts(build):
    feed = build([(1, "set", "2024-01", "A", 1), (1, "set", "2024-01", "A", 1), (2, "set", "2024-03", "A", 1), (2, "delete", "2024-04", "A", 1)])
    done = scd2.scd2_apply(None, feed).materialized()
    assert done.rejects.where("reason = 'repeated_seq'").count() == 2
    assert done.rows.where("not stored").select("seq").distinct().count() == done.rows.count()


def test_a_change_without_a_number_is_rejected(build):
    feed = build([(1, "set", "2024-01", "A", 1)]).withColumn("seq", F.lit(None).cast("long"))
    assert [r.reason for r in scd2.scd2_apply(None, feed).rejects.collect()] == ["missing_seq"]


def test_feeds_have_ids_of_their_own(build):
    feed = build([(1, "set", "2024-01", "A", 1)])
    ids = {scd2.scd2_apply(None, feed, feed=name).inserted.first().id for name in ("", "a", "b")}
    assert len(ids) == 3


def test_a_failed_batch_is_not_seen_and_its_repeat_counts_once(spark, tmp_path, build):
    root = str(tmp_path / "table")
    store.apply_change_batch(build([(1, "set", "2024-01", "A", 1)]), "a", root, buckets=2)
    # Rows of a job that never committed.
    junk = store.read_entries(spark, root).withColumns({"has_row": F.lit(True), "last_seq": F.lit(9).cast("long"), "bucket": F.lit(0)})
    publish.write_batch(junk, root, "open", 1, ["bucket"])
    publish.write_batch(store.read_entries(spark, root), root, "settled", 1)
    assert store.read_entries(spark, root).count() == 1
    store.apply_change_batch(build([(2, "set", "2024-03", "A", 1)]), "b", root, buckets=2)
    rows = store.read_entries(spark, root).orderBy("valid_from").collect()
    assert [(str(r.valid_from), r.valid_to and str(r.valid_to)) for r in rows] == [("2024-01-01", "2024-03-01"), ("2024-03-01", None)]


def test_a_store_can_start_from_a_table(spark, tmp_path, entries, build):
    root = str(tmp_path / "table")
    store.start_store(entries(dict(id="x", valid_from="2024-01"), dict(id="y", employee="B", valid_from="2023-01", valid_to="2023-05")), root, buckets=2)
    store.apply_change_batch(build([(1, "set", "2024-06", "A", 1)]), "a", root, buckets=2)
    rows = {r.id: r for r in store.read_entries(spark, root).collect()}
    assert len(rows) == 3 and str(rows["x"].valid_to) == "2024-06-01" and str(rows["y"].valid_to) == "2023-05-01"
    with pytest.raises(ValueError):
        store.start_store(entries(dict(valid_from="2024-01")), root)
    with pytest.raises(ValueError):
        store.start_store(entries(dict(id="a", valid_from="2024-01"), dict(id="b", valid_from="2024-02")), str(tmp_path / "two"))


def test_audit_of_a_repeated_publish_is_appended_once(spark, tmp_path, entries):
    root, staging = str(tmp_path / "t"), str(tmp_path / "s")
    rows = entries(dict(id="x", valid_from="2024-01"), dict(id="y", employee="B", valid_from="2024-01"), dict(id="z", version="v2", valid_from="2024-01"))
    tables.write_table(rows, root, "forecast_entries")
    ask = spark.createDataFrame([("v1", "A", None, "u", NOW)], "version_id string, employee_id string, container_id string, deleted_by string, deleted_at timestamp")
    read = lambda: tables.read_table(spark, root, "forecast_entries")
    log = lambda: tables.read_table(spark, root, "forecast_entry_audit")
    publish.append_audit(scd2.soft_delete(read(), ask).audit(), root)  # and then the job fails
    for _ in range(2):
        publish.publish_flagged(scd2.soft_delete(read(), ask), root, staging)
    assert [(r.forecast_entry_id, r.action, r.changed_by) for r in log().collect()] == [("x", "DELETE", "u")]
    assert {r.id: r.is_deleted for r in read().collect()} == {"x": True, "y": False, "z": False}
    back = spark.createDataFrame([("x",)], "id string")
    later = NOW + dt.timedelta(days=1)
    for _ in range(2):
        publish.publish_flagged(scd2.restore(read(), back), root, staging, "v", later)
    assert sorted((r.action, r.changed_by) for r in log().collect()) == [("DELETE", "u"), ("RESTORE", "v")]
    assert not read().where("is_deleted").count() and read().schema.fieldNames()[0] == TABLES["forecast_entries"].fieldNames()[0]
    with pytest.raises(ValueError):
        scd2.restore(read().withColumn("is_deleted", F.lit(True)), back).audit()
