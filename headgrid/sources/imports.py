"""Monthly snapshot files and their import."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from headgrid.functions.keys import hashed_id
from headgrid.operators.lookup import run_by_period
from headgrid.operators.rules import check_table
from headgrid.schema import IMPORT_ROW
from headgrid.session import broadcast_if_small, cut
from headgrid.sources.tables import conform

BAD = "_corrupt_record"
PERIOD = ["period_year", "period_month"]


class PeriodExists(ValueError):
    """The period was imported before; its actuals are immutable."""


@dataclass
class ImportFile:
    """Rows that fit the schema, and the raw lines that do not."""

    rows: DataFrame
    quarantine: DataFrame


def read_import_file(spark: SparkSession, path: str, fmt: str = "json", schema: T.StructType = IMPORT_ROW, **options) -> ImportFile:
    """Read JSON lines, or CSV records below a header, with a fixed schema.

    What is broken, or holds a value of the wrong type, is set aside whole with
    its text; it is neither loaded in part nor lost.

    A CSV record may have line breaks inside quotes, and doubled quotes stand for one. CSV files of one
    load share their header, which may name the columns in any order; a file with another one is an
    error. Only the first record of a file is its header. As records can't be found from the middle of such a
    file, each file is read by one task, as a stream. A quote that never closes takes the rest of its file into one
    record; so in a file with an odd number of quotes, records with line breaks are set aside, written anew as CSV.
    """
    if fmt == "json":
        return parse_import_lines(spark.read.text(path), schema=schema, **options)
    if fmt != "csv":
        raise ValueError(f"cannot import {fmt} files")
    # Without column pruning all values of a record are judged, whatever is read of it.
    options = {"header": True, "multiLine": True, "escape": '"', "maxCharsPerColumn": -1, "columnPruning": False, **options}
    names = [n.strip() for n in spark.read.options(**options).csv(path).columns]
    known = [schema[n] if n in schema.fieldNames() else T.StructField(n, T.StringType()) for n in names]
    with_bad = T.StructType([*known, T.StructField(BAD, T.StringType())])
    reader = spark.read.options(mode="PERMISSIVE", columnNameOfCorruptRecord=BAD, enforceSchema=False, **options)
    records = reader.schema(with_bad).csv(path).select("*", F.col("_metadata.file_path").alias("__file"))
    quotes = spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("__file")).agg(F.sum(F.regexp_count("value", F.lit('"'))).alias("n"))
    unclosed = broadcast_if_small(cut(quotes.where("n % 2 = 1").select("__file", F.lit(True).alias("__odd"))))
    texts = F.concat(*[F.coalesce(F.col(f"`{f.name}`"), F.lit("")) for f in known if f.dataType == T.StringType()], F.lit(""))
    doubtful = F.col("__odd").isNotNull() & F.contains(texts, F.lit("\n"))
    anew = F.to_csv(F.struct(*[F.col(f"`{n}`") for n in names]), {"escape": '"'})
    line = F.coalesce(F.col(BAD), F.when(doubtful, anew))
    judged = cut(records.join(unclosed, "__file", "left").withColumn("__line", line))
    rows = [F.col(f.name) if f.name in names else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    return ImportFile(judged.where("__line is null").select(*rows), judged.where("__line is not null").select(F.col("__line").alias("line")))


def parse_import_lines(lines: DataFrame, column: str = "value", schema: T.StructType = IMPORT_ROW, fmt: str = "json", **options) -> ImportFile:
    """The same for lines that are a text column already."""
    with_bad = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD, **options}
    if fmt == "json":
        parsed = F.from_json(column, with_bad, options)
    else:
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in with_bad.fields)
        parsed = F.from_csv(column, ddl, options)
    others = [c for c in lines.columns if c != column]
    rows = lines.where(F.trim(column) != "").withColumn("__row", parsed)
    bad = F.col("__row").isNull() | F.col(f"__row.{BAD}").isNotNull()
    names = [F.col(f"__row.{n}").alias(n) for n in schema.fieldNames()]
    return ImportFile(rows.where(~bad).select(*others, *names), rows.where(bad).select(*others, F.col(column).alias("line")))


@dataclass
class Import:
    """Header rows and actuals to append, and rows of periods that were refused."""

    runs: DataFrame
    actuals: DataFrame
    refused: DataFrame

    @property
    def violations(self) -> DataFrame:
        """Broken rules of the rows and headers to append: FTE range, missing values, an employee twice in a run, periods."""
        rows = check_table("employee_actuals", conform(self.actuals, "employee_actuals"))
        return rows.unionByName(check_table("import_runs", conform(self.runs, "import_runs")))


def import_actuals(runs: DataFrame, batch: DataFrame, user: str, at: dt.datetime, source_file: str | None = None) -> Import:
    """Prepare the load of monthly snapshots.

    ``batch`` has the import columns and ``period_year``/``period_month``; one batch
    may hold several months. A month with any run, whatever its status, is refused.
    The header carries the final row count, so writing it last makes a run visible
    only when its rows are.
    """
    new = batch.join(runs.select(*PERIOD), PERIOD, "left_anti")
    refused = batch.join(runs.select(*PERIOD), PERIOD, "left_semi")
    run_id = hashed_id(F.lit("run"), *PERIOD)
    actuals = new.select(
        hashed_id(F.lit("actual"), *PERIOD, "employee_id").alias("id"),
        run_id.alias("import_run_id"),
        *[F.col(c) for c in IMPORT_ROW.fieldNames() if c in batch.columns],
        F.lit(at).alias("created_at"),
    )
    headers = (
        new.groupBy(*PERIOD)
        .agg(F.count("*").cast("int").alias("row_count"))
        .select(
            run_id.alias("id"),
            *PERIOD,
            F.lit("completed").alias("status"),
            "row_count",
            F.lit(source_file).cast("string").alias("source_file"),
            F.lit(user).alias("imported_by"),
            F.lit(at).alias("imported_at"),
        )
    )
    return Import(headers, actuals, refused)


def import_month(runs: DataFrame, rows: DataFrame, year: int, month: int, user: str, at: dt.datetime, source_file: str | None = None) -> Import:
    """Load one month; raises :class:`PeriodExists` if it was loaded before."""
    spark = runs.sparkSession
    period = spark.createDataFrame([(year, month)], "period_year short, period_month short")
    if not run_by_period(runs, period).isEmpty():
        raise PeriodExists(f"import run for {year}-{month:02d} already exists")
    batch = rows.withColumn("period_year", F.lit(year).cast("short")).withColumn("period_month", F.lit(month).cast("short"))
    return import_actuals(runs, batch, user, at, source_file)


def import_run_counts(runs: DataFrame, actuals: DataFrame) -> DataFrame:
    """Run headers with the number of rows that are really there."""
    counts = actuals.groupBy(F.col("import_run_id").alias("id")).agg(F.count("*").cast("int").alias("row_count"))
    kept = runs.drop("row_count").join(counts, "id", "left")
    return kept.withColumn("row_count", F.coalesce("row_count", F.lit(0)))
