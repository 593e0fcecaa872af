"""A change feed applied to a stored versioned table, by batch jobs and by a stream.

Layout below the root folder, one sub-folder per batch:

* ``open``: one row per subject, with its open row (or none, after a delete) and the mark up
  to which its changes were delivered; split into buckets by subject, and a batch rewrites the
  buckets that it touches and no others;
* ``settled``: rows that were closed or deleted, append-only;
* ``audit`` and ``rejects``: append-only;
* ``commits``: written last; readers take only what is listed here.

Rows and marks of a subject become visible together. A job that is run again after a failure
overwrites its own folders, one that is committed already is skipped, and a change that is
delivered by another job again is rejected by its subject's mark, so each change counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from headgrid.functions.keys import SUBJECT, join_on
from headgrid.functions.temporal import is_open
from headgrid.operators.scd2 import SPLIT_ROWS, scd2_apply
from headgrid.schema import TABLES
from headgrid.session import cut
from headgrid.sources.publish import (
    commit_batch,
    committed_batches,
    job_is_committed,
    read_appended,
    read_current,
    write_batch,
)
from headgrid.sources.tables import conform

BUCKETS = 64
ENTRIES = TABLES["forecast_entries"]
AUDIT = TABLES["forecast_entry_audit"]
HEAD = T.StructType([*ENTRIES.fields]).add("has_row", T.BooleanType()).add("last_seq", T.LongType())
REJECT = T.StructType([ENTRIES[c] for c in SUBJECT]).add("seq", T.LongType()).add("valid_from", T.DateType()).add("reason", T.StringType())


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*SUBJECT), F.lit(buckets)).cast("int")


def _write(root: str, number: int, job: str, touched: list[int], buckets: int, heads: DataFrame, settled, audit=None, rejects=None) -> None:
    """Write the tables of one batch, then its commit."""
    spark = heads.sparkSession
    # Rebalancing lets Spark split a large bucket over several tasks and files.
    write_batch(heads.withColumn("bucket", _bucket(buckets)).hint("rebalance", "bucket"), root, "open", number, ["bucket"])
    write_batch(settled, root, "settled", number)
    empty = spark.createDataFrame([], AUDIT)
    write_batch(empty if audit is None else conform(audit, "forecast_entry_audit"), root, "audit", number)
    write_batch(spark.createDataFrame([], REJECT) if rejects is None else rejects, root, "rejects", number)
    schema = T.StructType([*HEAD.fields]).add("bucket", T.IntegerType())
    written = spark.read.schema(schema).parquet(f"{root}/open/batch={number}")
    counts = written.groupBy("bucket").agg(F.count("*").alias("n_rows"))
    named = spark.createDataFrame([(b,) for b in touched], "bucket int").join(counts, "bucket", "left")
    named = named.select("bucket", F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"))
    commit_batch(root, number, named, job)


def _next_number(spark: SparkSession, root: str) -> int:
    done = committed_batches(spark, root)
    return done[-1] + 1 if done else 0


def start_store(entries: DataFrame, root: str, buckets: int = BUCKETS) -> None:
    """Make a store of a table that was kept elsewhere. Its subjects have no mark yet.

    A subject has one open row at most; two raise.
    """
    spark = entries.sparkSession
    if committed_batches(spark, root):
        raise ValueError(f"{root} holds a store already")
    rows = cut(conform(entries, "forecast_entries"))
    live = rows.where(is_open())
    twice = live.groupBy(*SUBJECT).count().where("count > 1").take(5)
    if twice:
        raise ValueError(f"more than one open row: {twice}")
    heads = live.withColumns({"has_row": F.lit(True), "last_seq": F.lit(None).cast("long")})
    _write(root, 0, "start", list(range(buckets)), buckets, heads, rows.where(~is_open()))


def apply_change_batch(
    changes: DataFrame, job: int | str, root: str, buckets: int = BUCKETS, split_rows: int = SPLIT_ROWS, feed: str = ""
) -> None:
    """Apply one batch of changes and publish rows, marks, audit and rejects together.

    ``job`` names the batch within ``feed``. Batch jobs and streams on the same root see each
    other's rows. One job at a time writes to a root.
    """
    spark = changes.sparkSession
    job = f"{feed}/{job}" if feed else str(job)
    if job_is_committed(spark, root, job):
        return
    number = _next_number(spark, root)
    changes = cut(changes)
    # At most `buckets` rows.
    touched = [r.bucket for r in changes.select(_bucket(buckets).alias("bucket")).distinct().collect()]
    if not touched:
        return
    heads = read_current(spark, root, "open", HEAD, touched)
    before = heads.where("has_row").drop("has_row", "last_seq")
    marks = heads.select(*SUBJECT, "last_seq")
    done = scd2_apply(before, changes, split_rows=split_rows, marks=marks, feed=feed).materialized()
    ended = done.rows.where("stored").select("id")
    final = conform(done.final, "forecast_entries")
    open_now = before.join(ended, "id", "left_anti").unionByName(final.where(is_open()))
    marks_now = marks.unionByName(done.marks).groupBy(*SUBJECT).agg(F.max("last_seq").alias("last_seq"))
    heads_now = join_on(marks_now, open_now, SUBJECT, "left").withColumn("has_row", F.col("id").isNotNull())
    heads_now = heads_now.select(*HEAD.fieldNames())
    _write(root, number, job, touched, buckets, heads_now, final.where(~is_open()), done.audit, done.rejects)


def stream_scd2(
    changes: DataFrame, root: str, checkpoint: str, buckets: int = BUCKETS, split_rows: int = SPLIT_ROWS, feed: str = ""
) -> StreamingQuery:
    """Run the feed's backlog through :func:`apply_change_batch` and stop.

    Changes that come too late are not dropped by a watermark: marks and month rules reject
    them, and they are kept under ``rejects``.
    """
    return (
        changes.writeStream.foreachBatch(lambda df, batch: apply_change_batch(df, batch, root, buckets, split_rows, feed))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_entries(spark: SparkSession, root: str) -> DataFrame:
    """The table after all committed batches."""
    live = read_current(spark, root, "open", HEAD).where("has_row").drop("has_row", "last_seq")
    return live.unionByName(read_appended(spark, root, "settled", ENTRIES))


def read_marks(spark: SparkSession, root: str) -> DataFrame:
    """The highest sequence number that was delivered, for each subject."""
    return read_current(spark, root, "open", HEAD).select(*SUBJECT, "last_seq").where(F.col("last_seq").isNotNull())


def read_audit(spark: SparkSession, root: str) -> DataFrame:
    """Change records of all committed batches."""
    return read_appended(spark, root, "audit", AUDIT)


def read_rejects(spark: SparkSession, root: str) -> DataFrame:
    """Rejected changes of all committed batches."""
    return read_appended(spark, root, "rejects", REJECT)
