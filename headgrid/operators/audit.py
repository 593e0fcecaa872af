"""Column-level change capture."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from headgrid.functions.keys import distinct_from, hashed_id
from headgrid.session import BROADCAST_ROWS

# Columns whose changes are recorded (fixed values).
TRACKED = (
    "employee_id",
    "container_id",
    "first_name",
    "last_name",
    "costcenter_id",
    "classification_id",
    "employee_group_id",
    "job_description",
    "fte",
    "valid_from",
    "valid_to",
    "is_deleted",
)
CHANGE_MAP = "map<string,struct<old:string,new:string>>"
# Field under which the record of a removed row keeps the whole row (fixed value).
SNAPSHOT = "deleted_snapshot"


def field_change(name: str, old: Column, new: Column) -> Column:
    return F.create_map(F.lit(name), F.struct(old.alias("old"), new.alias("new"))).cast(CHANGE_MAP)


def audit_record(changes: DataFrame) -> DataFrame:
    """Give change rows their id."""
    ident = hashed_id("forecast_entry_id", "action", "changed_at", F.to_json("changed_fields"))
    return changes.withColumn("id", ident).select(
        "id", "forecast_entry_id", "version_id", "action", "changed_fields", "changed_by", "changed_at"
    )


def _differing(before: DataFrame, after: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Keys that are not held by exactly one equal row on each side."""
    # Hashes skip NULLs, so each column goes with a flag.
    values = [F.col(c) for c in names] + [F.col(c).isNull() for c in names]
    digests = [F.xxhash64(*values).alias("one"), F.xxhash64(F.lit("two"), *reversed(values)).alias("two")]
    sides = [df.select(F.col(key).alias("key"), F.lit(n).alias("n"), *digests) for df, n in ((before, 0), (after, 1))]
    counted = sides[0].unionByName(sides[1]).groupBy("key").agg(
        F.count("*").alias("rows"), F.sum("n").alias("new_rows"), F.bit_xor("one").alias("one"), F.bit_xor("two").alias("two")
    )
    return counted.where("rows <> 2 or new_rows <> 1 or one <> 0 or two <> 0").select("key")


def audit_diff(
    before: DataFrame,
    after: DataFrame,
    changed_by: str | Column,
    changed_at: Column,
    key: str = "id",
    tracked=TRACKED,
) -> DataFrame:
    """Change records between two states of the rows.

    A new row gives INSERT without fields. A changed row gives the changed columns
    with old and new value; a switch of ``is_deleted`` makes it DELETE or RESTORE. A
    row without a tracked change gives nothing. A row that is only in ``before`` gives
    DELETE with all its columns as JSON, the old value of ``deleted_snapshot``; so both
    sides must cover the same scope. A NULL ``changed_by`` is an error.

    Keys and 128-bit digests of the tracked columns are summed up in one narrow shuffle first; only
    rows of keys whose digests differ are joined with their columns.
    """
    actor = F.lit(changed_by) if isinstance(changed_by, str) else changed_by
    names = [c for c in tracked if c in before.columns and c in after.columns]
    differ = _differing(before, after, key, names)
    before, after = (df.join(differ.withColumnRenamed("key", key), key, "left_semi") for df in (before, after))
    old = before.select(F.col(key).alias("key"), F.struct(*before.columns).alias("old"))
    carried = [f"{side}.version_id" for side, df in (("new", after), ("old", before)) if "version_id" in df.columns]
    scope = ["version_id"] if "version_id" in after.columns and "version_id" not in names else []
    new = after.select(F.col(key).alias("key"), F.struct(*names, *scope).alias("new"))
    pair = new.join(old, "key", "full")
    differing = reduce(lambda a, b: a | b, [distinct_from(F.col(f"old.{c}"), F.col(f"new.{c}")) for c in names])
    is_new, is_gone = F.col("old").isNull(), F.col("new").isNull()
    entries = [
        F.struct(
            F.lit(c).alias("key"),
            F.struct(
                F.col(f"old.{c}").cast("string").alias("old"),
                F.col(f"new.{c}").cast("string").alias("new"),
            ).alias("value"),
        )
        for c in names
    ]
    kept = F.filter(F.array(*entries), lambda e: distinct_from(e["value"]["old"], e["value"]["new"]))
    snapshot = F.struct(F.to_json("old", {"ignoreNullFields": "false"}).alias("old"), F.lit(None).cast("string").alias("new"))
    changes = F.when(is_gone, F.create_map(F.lit(SNAPSHOT), snapshot)).when(~is_new, F.map_from_entries(kept))
    action = F.when(is_new, "INSERT").when(is_gone, "DELETE")
    if "is_deleted" in names:
        action = action.when(F.col("old.is_deleted") & ~F.col("new.is_deleted"), "RESTORE").when(
            ~F.col("old.is_deleted") & F.col("new.is_deleted"), "DELETE"
        )
    records = pair.where(is_new | is_gone | differing).select(
        F.col("key").alias("forecast_entry_id"),
        F.coalesce(*carried, F.lit(None).cast("string")).alias("version_id"),
        action.otherwise("UPDATE").alias("action"),
        changes.cast(CHANGE_MAP).alias("changed_fields"),
        F.coalesce(actor, F.raise_error(F.lit("an audited change needs an actor")).cast("string")).alias("changed_by"),
        changed_at.alias("changed_at"),
    )
    return audit_record(records)


def changed_fields_json(audit: DataFrame) -> DataFrame:
    """The change map as JSON text; NULL old or new values are written out."""
    return audit.withColumn("changed_fields", F.to_json("changed_fields", {"ignoreNullFields": "false"}))


def audit_explode(audit: DataFrame) -> DataFrame:
    """One row per changed column. Reads the map form and the JSON text form."""
    fields = F.col("changed_fields")
    if dict(audit.dtypes)["changed_fields"] == "string":
        fields = F.from_json(fields, CHANGE_MAP)
    return audit.select(
        "id", "forecast_entry_id", "action", F.explode(fields).alias("field", "change")
    ).select("id", "forecast_entry_id", "action", "field", F.col("change.old").alias("old"), F.col("change.new").alias("new"))


def audit_entry_history(audit: DataFrame, entries: DataFrame | None = None, ordered: bool = False) -> DataFrame:
    """Changes of the listed entries (column ``forecast_entry_id``), newest first when ``ordered``."""
    rows = audit
    if entries is not None:
        rows = audit.join(entries.select("forecast_entry_id").distinct(), "forecast_entry_id", "left_semi")
    if ordered:
        rows = rows.orderBy("forecast_entry_id", F.desc("changed_at"), F.desc("id"))
    return rows


def audit_version_feed(audit: DataFrame, entries: DataFrame, version: str, limit: int) -> DataFrame:
    """The newest ``limit`` changes of a version with their subject and cost centre.

    Changes of one transaction share their time, so action and id break ties. The top rows
    are taken before the join: each audit row belongs to exactly one entry, so the
    join, which needs the whole entry table, sees ``limit`` rows on one side.
    """
    known = entries.where(F.col("version_id") == version)
    newest = (
        audit.where(F.col("version_id") == version)
        .orderBy(F.desc("changed_at"), "action", F.desc("id"))
        .limit(limit)
    )
    subject = known.select(F.col("id").alias("forecast_entry_id"), "employee_id", "container_id", "costcenter_id")
    if limit <= BROADCAST_ROWS:
        newest = F.broadcast(newest)
    return subject.join(newest, "forecast_entry_id").orderBy(F.desc("changed_at"), "action", F.desc("id"))
