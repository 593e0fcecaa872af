"""A drop folder of monthly snapshot files loaded into the actuals.

Lines are judged one by one: a broken line, a row or period that breaks a rule, and an employee
that a month names twice go to ``quarantine`` with the reason and their text, and never stop the
folder. A month can be held open until its end marker is there, a line with the period and
``expected_rows``; then it does not matter in how many files and micro-batches it arrives.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from headgrid.functions.keys import join_on
from headgrid.operators.rules import table_conditions
from headgrid.schema import CHECKS, IMPORT_ROW, TABLES
from headgrid.session import cut
from headgrid.sources.imports import PERIOD, import_actuals, parse_import_lines
from headgrid.sources.publish import commit_batch, is_committed, read_appended, write_batch
from headgrid.sources.tables import conform

DROP_ROW = T.StructType([*IMPORT_ROW.fields]).add("period_year", T.ShortType()).add("period_month", T.ShortType())
DROP_LINE = T.StructType([*DROP_ROW.fields]).add("expected_rows", T.IntegerType())
MARKER = T.StructType([DROP_LINE[c] for c in (*PERIOD, "expected_rows")])
QUARANTINE = T.StructType([DROP_ROW[c] for c in PERIOD]).add("reason", T.StringType()).add("line", T.StringType())


def read_drop_folder(spark: SparkSession, path: str) -> DataFrame:
    """Stream of JSON lines. There is no limit on files per batch."""
    return spark.readStream.text(path)


def _rules() -> dict[str, str]:
    """Rules of a row and of the run that it belongs to, as far as the line has their columns."""
    rules = table_conditions("employee_actuals", IMPORT_ROW.fieldNames())
    rules |= {name: condition for name, condition in CHECKS["import_runs"].items() if "period" in condition}
    return rules | {f"{c}_not_null": f"{c} is not null" for c in PERIOD}


def _set_aside(rows: DataFrame, reason) -> DataFrame:
    line = F.to_json(F.struct(*DROP_ROW.fieldNames()))
    return rows.select(*PERIOD, reason.alias("reason"), line.alias("line"))


def load_drop_batch(lines: DataFrame, batch: int, root: str, user: str, at: dt.datetime, hold: bool = False) -> None:
    """Load one micro-batch of lines. Months that have a run already are kept under ``refused``.

    With ``hold`` a month is loaded by the batch after which it has its marker and at least as many
    rows, those in quarantine included; without, by the batch that brings its first rows.
    """
    spark = lines.sparkSession
    if is_committed(spark, root, batch):
        return
    parsed = parse_import_lines(cut(lines), schema=DROP_LINE)
    broken = parsed.quarantine.select(
        *[F.lit(None).cast("short").alias(c) for c in PERIOD], F.lit("broken_line").alias("reason"), "line"
    )
    markers = parsed.rows.where("expected_rows is not null").select(*MARKER.fieldNames())
    failed = F.filter(F.array(*[F.when(~F.expr(rule), F.lit(name)) for name, rule in _rules().items()]), lambda x: x.isNotNull())
    rows = cut(parsed.rows.where("expected_rows is null").drop("expected_rows").withColumn("failed", F.array_sort(failed)))
    sound = rows.where(F.size("failed") == 0).drop("failed")
    unsound = _set_aside(rows.where(F.size("failed") > 0), F.array_join("failed", ","))
    runs = read_appended(spark, root, "import_runs", TABLES["import_runs"]).select(*PERIOD)
    refused = sound.join(runs, PERIOD, "left_semi").select(*DROP_ROW.fieldNames())
    new = sound.join(runs, PERIOD, "left_anti").select(*DROP_ROW.fieldNames())
    # Partitioned by month: months that were loaded are not read again.
    write_batch(new, root, "arrived", batch, PERIOD)
    write_batch(markers, root, "markers", batch)
    due = new
    if hold:
        arrived = _seen(spark, root, "arrived", DROP_ROW, new).join(runs, PERIOD, "left_anti")
        aside = _seen(spark, root, "quarantine", QUARANTINE, unsound)
        there = arrived.select(*PERIOD).unionByName(aside.select(*PERIOD)).groupBy(*PERIOD).agg(F.count("*").alias("n"))
        wanted = _seen(spark, root, "markers", MARKER, markers).groupBy(*PERIOD).agg(F.max("expected_rows").alias("expected"))
        complete = there.join(wanted, PERIOD).where("n >= expected").select(*PERIOD)
        due = cut(arrived.join(complete, PERIOD, "left_semi").select(*DROP_ROW.fieldNames()))
    who = [*PERIOD, "employee_id"]
    twice = due.groupBy(*who).agg(F.count("*").alias("n")).where("n > 1").select(*who)
    repeated = _set_aside(join_on(due, twice, who, "left_semi"), F.lit("unique_import_run_id_employee_id"))
    load = import_actuals(runs, join_on(due, twice, who, "left_anti"), user, at)
    write_batch(conform(load.actuals, "employee_actuals"), root, "employee_actuals", batch)
    write_batch(refused, root, "refused", batch)
    write_batch(broken.unionByName(unsound).unionByName(repeated), root, "quarantine", batch)
    write_batch(conform(load.runs, "import_runs"), root, "import_runs", batch)
    commit_batch(root, batch, spark.createDataFrame([(0, 0)], "bucket int, n_rows long"))


def _seen(spark: SparkSession, root: str, table: str, schema: T.StructType, now: DataFrame) -> DataFrame:
    """What earlier batches brought, and this one."""
    return read_appended(spark, root, table, schema).unionByName(now)


def stream_import(rows: DataFrame, root: str, checkpoint: str, user: str, at: dt.datetime, hold: bool = False) -> StreamingQuery:
    """Load everything that is in the drop folder and stop."""
    return (
        rows.writeStream.foreachBatch(lambda df, batch: load_drop_batch(df, batch, root, user, at, hold))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_loaded(spark: SparkSession, root: str, table: str) -> DataFrame:
    """``import_runs`` or ``employee_actuals`` of all committed batches."""
    return read_appended(spark, root, table, TABLES[table])


def refused_rows(spark: SparkSession, root: str) -> DataFrame:
    """Rows of months that were loaded before."""
    return read_appended(spark, root, "refused", DROP_ROW)


def quarantined(spark: SparkSession, root: str) -> DataFrame:
    """Lines that were set aside, with their period where it could be read."""
    return read_appended(spark, root, "quarantine", QUARANTINE)


def open_months(spark: SparkSession, root: str) -> DataFrame:
    """Months with rows but no run: how many rows are there and how many are expected (NULL without a marker)."""
    runs = read_loaded(spark, root, "import_runs").select(*PERIOD)
    arrived = read_appended(spark, root, "arrived", DROP_ROW).join(runs, PERIOD, "left_anti")
    wanted = read_appended(spark, root, "markers", MARKER).groupBy(*PERIOD).agg(F.max("expected_rows").alias("expected_rows"))
    return arrived.groupBy(*PERIOD).agg(F.count("*").alias("n_rows")).join(wanted, PERIOD, "left")
