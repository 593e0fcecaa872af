"""Planning tables derived from the star-schema tables, for tests and benchmarks.

Region, nation and supplier form the cost-centre tree; the orders of a customer are
its monthly states; every tenth customer is a planning container; ``events`` is a
feed of change requests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

FIRST_VERSION = "1998-10-01"
N_VERSIONS = 4
HORIZON = 18


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _code(prefix: str, column: str, width: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(F.col(column).cast("string"), width, "0"))


def costcenters(spark: SparkSession, sf_dir: str) -> DataFrame:
    def node(table, key, prefix, width, kind, name, level, parent, active):
        return read(spark, sf_dir, table).select(
            _code(prefix, key, width).alias("id"),
            F.concat(F.lit(kind), F.col(key).cast("string")).alias("code"),
            F.col(name).alias("name"),
            F.lit(level).alias("level"),
            parent.alias("parent_id"),
            active.alias("is_active"),
        )

    no_parent = F.lit(None).cast("string")
    regions = node("region", "r_regionkey", "R", 2, "DIV-", "r_name", 1, no_parent, F.lit(True))
    nations = node("nation", "n_nationkey", "N", 3, "DEP-", "n_name", 2, _code("R", "n_regionkey", 2), F.col("n_nationkey") % 11 != 10)
    suppliers = node("supplier", "s_suppkey", "S", 6, "CC-", "s_name", 3, _code("N", "s_nationkey", 3), F.col("s_suppkey") % 17 != 0)
    return regions.unionByName(nations).unionByName(suppliers)


def _month(column: str) -> Column:
    return F.trunc(F.col(column).cast("date"), "MM")


def _order_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = read(spark, sf_dir, "supplier").agg(F.count("*")).scalar()
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    classification = (
        F.when(priority == "1-URGENT", "direct")
        .when(priority == "2-HIGH", "indirect")
        .when(priority == "3-MEDIUM", "overhead")
        .when(priority == "4-NOT SPECIFIED", "contractor")
    )
    centre = F.lpad((F.col("o_orderkey") % suppliers).cast("string"), 6, "0")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        _month("o_orderdate").alias("m"),
        F.concat(F.lit("S"), centre).alias("costcenter_id"),
        classification.alias("classification_id"),
        F.when(status != "P", F.concat(F.lit("EG_"), status)).alias("employee_group_id"),
    )


def _last_of_month(rows: DataFrame, by: list[str]) -> DataFrame:
    """The row with the highest order number per group; combined before the shuffle."""
    rest = [c for c in rows.columns if c not in by and c != "o_orderkey"]
    last = rows.groupBy(*by).agg(F.max(F.struct("o_orderkey", *rest)).alias("r"))
    return last.select(*by, "r.*")


def employee_actuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _last_of_month(_order_states(spark, sf_dir), ["o_custkey", "m"])
    return rows.select(
        _code("A", "o_orderkey", 9).alias("id"),
        F.concat(F.lit("RUN-"), F.date_format("m", "yyyy-MM")).alias("import_run_id"),
        _code("C", "o_custkey", 8).alias("employee_id"),
        "costcenter_id",
        "classification_id",
        "employee_group_id",
        ((F.col("o_orderkey") % 8 + 1) * F.lit(0.125)).cast("decimal(6,4)").alias("fte"),
        F.col("m").alias("period_start"),
    )


def import_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = employee_actuals(spark, sf_dir).groupBy("import_run_id", "period_start").agg(F.count("*").alias("row_count"))
    return months.select(
        F.col("import_run_id").alias("id"),
        F.year("period_start").alias("period_year"),
        F.month("period_start").alias("period_month"),
        F.when(F.month("period_start") == 7, "failed").otherwise("completed").alias("status"),
        "row_count",
    )


def forecast_versions(spark: SparkSession, sf_dir: str, first: str | None = FIRST_VERSION, last: str | None = "1999-01-01") -> DataFrame:
    """One version per month of orders; the last one is the working version.

    Without bounds every month of the table is a version.
    """
    months = read(spark, sf_dir, "orders").select(_month("o_orderdate").alias("m")).distinct()
    if first is not None:
        months = months.where(F.col("m") >= F.lit(first).cast("date"))
    if last is not None:
        months = months.where(F.col("m") <= F.lit(last).cast("date"))
    by_month = Window.orderBy("m")  # one row per month: a few hundred at most
    numbered = months.select("m", F.row_number().over(by_month).alias("n"), F.lead("m").over(by_month).alias("later"))
    version = F.concat(F.lit("v"), F.col("n").cast("string"))
    return numbered.select(
        version.alias("id"),
        F.concat(F.lit("FC "), F.date_format("m", "yyyy-MM")).alias("label"),
        F.when(F.col("later").isNull(), "working").otherwise("archived").alias("status"),
        F.year("m").alias("period_year"),
        F.month("m").alias("period_month"),
        F.lit(HORIZON).alias("fc_horizon_months"),
        F.when(F.col("n") > 1, F.concat(F.lit("v"), (F.col("n") - 1).cast("string"))).alias("source_version_id"),
    )


def forecast_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of all customers in the four versions.

    So that versions differ, an order is unknown to one of the version numbers 0-4.
    """
    numbers = F.sequence(F.lit(1), F.lit(N_VERSIONS))
    states = _order_states(spark, sf_dir).withColumn("v", F.explode(numbers)).where(F.col("o_orderkey") % 5 != F.col("v"))
    rows = _last_of_month(states, ["v", "o_custkey", "m"])
    # One row per month by now, so a customer has few rows here however many orders it has.
    following = F.lead("m").over(Window.partitionBy("v", "o_custkey").orderBy("m"))
    rows = rows.withColumn("nx", following)
    container = F.col("o_custkey") % 10 == 0
    fte = F.when(container, (F.col("o_orderkey") % 25 - 8) * F.lit(0.25)).otherwise((F.col("o_orderkey") % 8 + 1) * F.lit(0.125))
    version = F.concat(F.lit("v"), F.col("v").cast("string"))
    return rows.select(
        F.concat_ws("-", version, F.col("o_orderkey").cast("string")).alias("id"),
        version.alias("version_id"),
        F.when(~container, _code("C", "o_custkey", 8)).alias("employee_id"),
        F.when(container, _code("P", "o_custkey", 8)).alias("container_id"),
        "costcenter_id",
        "classification_id",
        "employee_group_id",
        fte.cast("decimal(6,4)").alias("fte"),
        F.col("m").alias("valid_from"),
        F.col("nx").alias("valid_to"),
        (F.col("nx").isNull() & (F.col("o_orderkey") % 13 == 0)).alias("is_deleted"),
    )


def full_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows with all columns of the table; names and actors are taken from the row."""
    return forecast_entries(spark, sf_dir).select(
        "id",
        "version_id",
        "employee_id",
        "container_id",
        F.coalesce("employee_id", "container_id").alias("first_name"),
        F.col("costcenter_id").alias("last_name"),
        "costcenter_id",
        "classification_id",
        "employee_group_id",
        F.lit(None).cast("string").alias("job_description"),
        "fte",
        "valid_from",
        "valid_to",
        "is_deleted",
        F.when(F.col("is_deleted"), F.col("valid_from").cast("timestamp")).alias("deleted_at"),
        F.when(F.col("is_deleted"), F.lit("planner")).alias("deleted_by"),
        F.lit("planner").alias("created_by"),
        F.col("valid_from").cast("timestamp").alias("created_at"),
    )


def change_feed(events: DataFrame, containers: bool | None = None) -> DataFrame:
    """One change request per event, in event order.

    An ``error`` deletes the open row, any other event sets a state. All events fall
    in one month, so the day of the month picks the effective month. Every tenth
    user is a container unless ``containers`` makes all users one kind.
    """
    is_container = F.col("user_id") % 10 == 0 if containers is None else F.lit(containers)
    user = F.col("user_id").cast("string")
    day = F.dayofmonth("ts")
    return events.select(
        F.lit("feed").alias("version_id"),
        F.when(~is_container, F.concat(F.lit("U"), user)).alias("employee_id"),
        F.when(is_container, F.concat(F.lit("B"), user)).alias("container_id"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "delete").otherwise("set").alias("op"),
        F.add_months(F.lit("2024-01-01").cast("date"), day - 1).alias("valid_from"),
        F.concat(F.lit("U"), user).alias("first_name"),
        F.col("event_type").alias("last_name"),
        F.concat(F.lit("CC-"), (F.col("event_id") % 7).cast("string")).alias("costcenter_id"),
        F.lit(None).cast("string").alias("classification_id"),
        F.lit(None).cast("string").alias("employee_group_id"),
        F.lit(None).cast("string").alias("job_description"),
        ((F.col("event_id") % 8 + 1) * F.lit(0.125)).cast("decimal(6,4)").alias("fte"),
        F.concat(F.lit("by-"), F.col("event_type")).alias("changed_by"),
        F.col("ts").cast("timestamp").alias("changed_at"),
    )
