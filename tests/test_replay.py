"""The windowed batch apply against a replay of one change at a time."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from headgrid.operators import scd2

MONTHS = [dt.date(2024 + i // 12, i % 12 + 1, 1) for i in range(30)]


def replay(feed):
    """``{subject: [[valid_from, valid_to, is_deleted, seq]]}`` and rejected seqs per subject."""
    rows, rejected = {}, set()
    for seq, op, month, subject, _ in sorted(feed):
        mine = rows.setdefault(subject, [])
        live = [r for r in mine if r[1] is None and not r[2]]
        if op == "delete":
            for r in live:
                r[2] = True
        elif any(month <= r[0] for r in live):
            rejected.add((subject, seq))
        else:
            for r in live:
                r[1] = month
            mine.append([month, None, False, seq])
    return {(s, *r) for s, found in rows.items() for r in found}, rejected


def feed_of(rng, n, subjects, deletes, hot=None):
    out = []
    for seq in range(n):
        subject = hot if hot and rng.random() < 0.6 else rng.choice(subjects)
        op = "delete" if rng.random() < deletes else "set"
        out.append((seq, op, rng.choice(MONTHS), subject, 1))
    return out


def outcome(done):
    # created_at carries the sequence number of the change that made the row.
    subject = F.coalesce("employee_id", "container_id").alias("s")
    seq = (F.unix_timestamp("created_at") - F.unix_timestamp(F.lit("2025-01-01 12:00:00"))).alias("seq")
    rows = done.select(subject, "valid_from", "valid_to", "is_deleted", seq).collect()
    return {tuple(r) for r in rows}, len(rows)


@pytest.fixture(scope="module")
def build(changes):
    return lambda feed: changes(*[(q, op, m.isoformat(), s, x) for q, op, m, s, x in feed])


@pytest.mark.parametrize("seed, deletes", [(1, 0.05), (2, 0.4), (3, 0.0)])
@pytest.mark.parametrize("split_rows", [1_000_000, 25])
def test_batch_equals_replay(build, seed, deletes, split_rows):
    rng = random.Random(seed)
    feed = feed_of(rng, 400, ["A", "B", "P1", "D"], deletes, hot="H")
    want, rejected = replay(feed)
    done = scd2.scd2_apply(None, build(feed), split_rows=split_rows).materialized()
    got, n = outcome(done.final)
    assert got == want and n == len(want)
    refused = done.rejects.select(F.coalesce("employee_id", "container_id"), "seq").collect()
    assert {tuple(r) for r in refused} == rejected and len(refused) == len(rejected)


@pytest.mark.parametrize("at, split_rows", [(90, 1_000_000), (200, 20)])
def test_two_batches_equal_one(build, at, split_rows):
    feed = feed_of(random.Random(7), 300, ["A", "B", "P1"], 0.1, hot="H")
    want, rejected = replay(feed)
    first = scd2.scd2_apply(None, build(feed[:at]), split_rows=split_rows).materialized()
    second = scd2.scd2_apply(first.final, build(feed[at:]), split_rows=split_rows).materialized()
    got, n = outcome(second.merge_into(first.final))
    assert got == want and n == len(want)
    assert first.rejects.count() + second.rejects.count() == len(rejected)
    inserts = first.audit.unionByName(second.audit).groupBy("action").count().collect()
    counts = {r["action"]: r["count"] for r in inserts}
    assert counts["INSERT"] == len(want)
    assert counts["UPDATE"] == sum(r[2] is not None for r in want)
    assert counts["DELETE"] == sum(r[3] for r in want)


def test_ids_do_not_depend_on_the_run(build):
    feed = build(feed_of(random.Random(9), 100, ["A", "P1"], 0.1))
    once = scd2.scd2_apply(None, feed).final.select("id")
    again = scd2.scd2_apply(None, feed.repartition(3), split_rows=10).final.select("id")
    assert once.exceptAll(again).isEmpty() and again.exceptAll(once).isEmpty()
    assert once.distinct().count() == once.count()
