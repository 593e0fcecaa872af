"""Publishing of results so that a failed or repeated job leaves no half-written state."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from headgrid.operators.scd2 import Flagged
from headgrid.operators.versions import Rollover
from headgrid.schema import TABLES
from headgrid.session import broadcast_if_small, cut
from headgrid.sources.imports import PERIOD, Import, PeriodExists
from headgrid.sources.tables import conform, read_table, write_table

COMMITS = "commits"
COMMIT_ROW = T.StructType().add("bucket", T.IntegerType()).add("n_rows", T.LongType()).add("batch", T.LongType()).add("job", T.StringType())


class RuleViolation(ValueError):
    """Staged rows break a table rule; nothing was published."""


def publish_partitions(df: DataFrame, staging: str, target: str, by: list[str], violations=None) -> None:
    """Write to ``staging``, check, then replace only the partitions that ``df`` holds.

    ``df`` may read ``target``: the staged copy is complete before anything is
    replaced. ``violations`` maps the staged rows to a listing that must be empty.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(staging)
    staged = spark.read.schema(df.schema).parquet(staging)
    if violations is not None:
        found = violations(staged).take(5)
        if found:
            raise RuleViolation(f"not published: {found}")
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(target)


def _folder(spark: SparkSession, path: str):
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path, files = _folder(spark, path)
    return files.exists(hadoop_path)


def generations(spark: SparkSession, root: str, table: str) -> list[int]:
    """Numbers of the complete generations of a small table."""
    base, files = _folder(spark, f"{root}/{table}")
    if not files.exists(base):
        return []
    names = [s.getPath().getName() for s in files.listStatus(base)]
    found = [int(n.split("=")[1]) for n in names if n.startswith("generation=")]
    return sorted(g for g in found if path_exists(spark, f"{root}/{table}/generation={g}/_SUCCESS"))


def publish_generation(df: DataFrame, root: str, table: str) -> None:
    """Replace a small table as a whole.

    The new state goes into a folder of its own, which counts from the moment its
    success mark is there; ``df`` may read the generation before.
    """
    done = generations(df.sparkSession, root, table)
    number = done[-1] + 1 if done else 0
    conform(df, table).write.mode("overwrite").parquet(f"{root}/{table}/generation={number}")


def read_generation(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The latest complete generation of a small table."""
    done = generations(spark, root, table)
    if not done:
        return spark.createDataFrame([], TABLES[table])
    return spark.read.schema(TABLES[table]).parquet(f"{root}/{table}/generation={done[-1]}")


def publish_rollover(done: Rollover, root: str) -> None:
    """Publish a rollover: rows and audit of the new version first, the registry last.

    Readers start from the registry, so a rollover that fails half-way is not seen.
    Its version id is the same when it is repeated, and the repeat replaces the rows.
    """
    write_table(done.seeded, root, "forecast_entries", only_its_partitions=True)
    write_table(done.audit, root, "forecast_entry_audit", only_its_partitions=True)
    publish_generation(done.versions, root, "forecast_versions")


def append_audit(records: DataFrame, root: str) -> None:
    """Add change records to the audit table, those that are not there yet.

    The id of a record is made of its content, so a job that is repeated adds nothing twice. Only
    the versions that the records belong to are read, and of those only the ids.
    """
    spark = records.sparkSession
    new = cut(conform(records, "forecast_entry_audit").dropDuplicates(["version_id", "id"]))
    if path_exists(spark, f"{root}/forecast_entry_audit"):
        there = read_table(spark, root, "forecast_entry_audit").select("version_id", "id")
        there = there.join(broadcast_if_small(new.select("version_id").distinct()), "version_id", "left_semi")
        new = new.join(there, ["version_id", "id"], "left_anti")
    new.write.mode("append").partitionBy("version_id").parquet(f"{root}/forecast_entry_audit")


def publish_flagged(done: Flagged, root: str, staging: str, changed_by: str | None = None, changed_at=None) -> None:
    """Publish a soft delete or restore: its audit first, then the versions that it touches.

    ``done`` was made from the stored table. A job that failed between the two gives the same
    records when it is repeated; one that is repeated as a whole finds nothing left to change.
    """
    done = replace(done, before=cut(done.before), after=cut(done.after))
    append_audit(done.audit(changed_by, changed_at), root)
    spark = done.after.sparkSession
    versions = done.after.select("version_id").distinct()
    # Partition values, a few for each job.
    stored = read_table(spark, root, "forecast_entries")
    touched = stored.join(broadcast_if_small(versions), "version_id", "left_semi")
    whole = conform(done.merge_into(touched), "forecast_entries")
    publish_partitions(whole, staging, f"{root}/forecast_entries", ["version_id"])


def publish_import(load: Import, root: str) -> None:
    """Publish a monthly load: the actuals first, the run headers last.

    The load is computed once. Nothing is written if a row or a header breaks a rule, or if a
    month has been published since the load was prepared.
    """
    load = replace(load, actuals=cut(load.actuals), runs=cut(load.runs))
    found = load.violations.take(5)
    if found:
        raise RuleViolation(f"not published: {found}")
    runs = read_generation(load.runs.sparkSession, root, "import_runs")
    there = load.runs.select(*PERIOD).join(runs.select(*PERIOD), PERIOD, "left_semi").take(5)
    if there:
        raise PeriodExists(f"published before: {there}")
    write_table(load.actuals, root, "employee_actuals", only_its_partitions=True)
    publish_generation(runs.unionByName(conform(load.runs, "import_runs")), root, "import_runs")


def write_batch(df: DataFrame, root: str, table: str, batch: int, by: list[str] | None = None) -> None:
    """Write the rows of one batch into a folder of their own.

    A repeated batch overwrites its own folder only, so a retry does no harm.
    """
    df.write.mode("overwrite").partitionBy(*(by or [])).parquet(f"{root}/{table}/batch={batch}")


def commit_batch(root: str, batch: int, touched: DataFrame, job: str | None = None) -> None:
    """Make a batch visible; call it after all tables of the batch are written.

    ``touched`` has one row per replaced bucket: ``bucket`` and its ``n_rows`` now. ``job``
    names the work that the batch holds, whoever ran it.
    """
    rows = touched.select("bucket", "n_rows", F.lit(job).cast("string").alias("job"))
    rows.coalesce(1).write.mode("overwrite").parquet(f"{root}/{COMMITS}/batch={batch}")


def is_committed(spark: SparkSession, root: str, batch: int) -> bool:
    return path_exists(spark, f"{root}/{COMMITS}/batch={batch}/_SUCCESS")


def committed_batches(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the batches whose commit is complete."""
    base, files = _folder(spark, f"{root}/{COMMITS}")
    if not files.exists(base):
        return []
    names = [s.getPath().getName() for s in files.listStatus(base)]
    batches = [int(n.split("=")[1]) for n in names if n.startswith("batch=")]
    return sorted(b for b in batches if is_committed(spark, root, b))


def job_is_committed(spark: SparkSession, root: str, job: str) -> bool:
    """Whether a committed batch holds this job."""
    paths = [f"{root}/{COMMITS}/batch={b}" for b in committed_batches(spark, root)]
    return not _read_paths(spark, root, COMMITS, COMMIT_ROW, paths).where(F.col("job") == job).isEmpty()


def _read_paths(spark: SparkSession, root: str, table: str, schema: T.StructType, paths: list[str]) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], schema)
    reader = spark.read.option("basePath", f"{root}/{table}").schema(schema)
    return reader.parquet(*paths).select(*schema.fieldNames())


def read_appended(spark: SparkSession, root: str, table: str, schema: T.StructType) -> DataFrame:
    """Rows that committed batches added to an append-only table."""
    paths = [f"{root}/{table}/batch={b}" for b in committed_batches(spark, root)]
    return _read_paths(spark, root, table, schema, paths)


def read_current(spark: SparkSession, root: str, table: str, schema: T.StructType, buckets: list[int] | None = None) -> DataFrame:
    """Rows of a bucketed table: each bucket from the last committed batch that replaced it.

    Only the folders of those batches are listed and read. The driver sees one line
    per bucket, a number fixed when the table is set up.
    """
    batches = committed_batches(spark, root)
    if not batches:
        return spark.createDataFrame([], schema)
    commits = _read_paths(spark, root, COMMITS, COMMIT_ROW, [f"{root}/{COMMITS}/batch={b}" for b in batches])
    if buckets is not None:
        commits = commits.where(F.col("bucket").isin(buckets))
    last = commits.groupBy("bucket").agg(F.max(F.struct("batch", "n_rows")).alias("last")).select("bucket", "last.*")
    filled = last.where("n_rows > 0").collect()
    paths = [f"{root}/{table}/batch={r.batch}/bucket={r.bucket}" for r in filled]
    return _read_paths(spark, root, table, schema, paths)
