"""The planning tables as Parquet folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from headgrid.schema import PARTITION_BY, SEED_CLASSIFICATIONS, SEED_CONFIG, SEED_GROUPS, TABLES
from headgrid.functions.keys import hashed_id


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def conform(df: DataFrame, name: str) -> DataFrame:
    """The columns of a table in order and type; columns that ``df`` lacks are NULL."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in TABLES[name].fields
        ]
    )


def write_table(df: DataFrame, root: str, name: str, only_its_partitions: bool = False) -> None:
    """Write a table in its layout, replacing it or only the partitions that ``df`` holds.

    Partitioned tables are rebalanced on the partition column: Spark splits a very
    large version over many tasks and files and joins small ones. Rows are sorted
    by cost centre within a file, which makes the column statistics selective.
    """
    by = PARTITION_BY.get(name, [])
    rows = conform(df, name)
    if by:
        rows = rows.hint("rebalance", *by)
        order = [*by, "costcenter_id"] if "costcenter_id" in rows.columns else by
        rows = rows.sortWithinPartitions(*order)
    kind = "dynamic" if only_its_partitions else "static"
    rows.write.mode("overwrite").option("partitionOverwriteMode", kind).partitionBy(*by).parquet(f"{root}/{name}")


def write_json(df: DataFrame, path: str) -> None:
    """Results as JSON lines, NULL fields included."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def _seed(spark: SparkSession, name: str, rows) -> DataFrame:
    columns = spark.createDataFrame(rows, "code string, label string, sort_order short")
    return conform(columns.withColumn("id", hashed_id(F.lit(name), "code")).withColumn("is_active", F.lit(True)), name)


def seed_classification_types(spark: SparkSession) -> DataFrame:
    return _seed(spark, "classification_types", SEED_CLASSIFICATIONS)


def seed_employee_groups(spark: SparkSession) -> DataFrame:
    return _seed(spark, "employee_groups", SEED_GROUPS)


def seed_system_config(spark: SparkSession, at) -> DataFrame:
    rows = spark.createDataFrame(SEED_CONFIG, "key string, value string, description string")
    return conform(rows.withColumn("updated_at", F.lit(at)), "system_config")
