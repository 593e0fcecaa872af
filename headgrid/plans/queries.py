"""One query per operator, over the driver's tables."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from headgrid.functions.keys import subject_key, subject_kind
from headgrid.operators import audit, diff, hierarchy, lookup, quality, rollup, rules, scd2, snapshot, versions
from headgrid.operators import upsert as upserts
from headgrid.plans.rule_tables import RULE_TABLES, SOURCES
from headgrid.schema import CHECKS
from headgrid.session import cut, shared_dir
from headgrid.sources import derived, imports, publish
from headgrid.sources.tables import conform, read_table, write_json, write_table
from headgrid.streaming import changes as change_stream
from headgrid.streaming import imports as import_stream

START, END = "1998-01-01", "1999-06-01"
MONTH = "1998-10-01"
NOW = dt.datetime(2024, 2, 1)
FEED_SIZE = 200

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _wide(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("decimal(38,4)") for c in columns})


def _time(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)


# Temporal reads


@query
def asof_snapshot(spark, sf_dir):
    return _wide(snapshot.asof_snapshot(derived.forecast_entries(spark, sf_dir), MONTH, "v4"), "fte")


@query
def asof_employee(spark, sf_dir):
    return _wide(snapshot.asof_employee(derived.forecast_entries(spark, sf_dir), MONTH, "v4"), "fte")


@query
def asof_container(spark, sf_dir):
    return _wide(snapshot.asof_container(derived.forecast_entries(spark, sf_dir), MONTH, "v4"), "fte")


@query
def open_rows(spark, sf_dir):
    return _wide(snapshot.open_rows(derived.forecast_entries(spark, sf_dir)), "fte")


@query
def month_spine(spark, sf_dir):
    orders = derived.read(spark, sf_dir, "orders")
    month = F.trunc(F.col("o_orderdate").cast("date"), "MM")
    spans = orders.groupBy("o_custkey").agg(F.min(month).alias("first_month"), F.max(month).alias("last_month"))
    return snapshot.month_spine(spans, "first_month", "last_month").select("o_custkey", "month_start")


@query
def next_period(spark, sf_dir):
    runs = derived.import_runs(spark, sf_dir).select("id", "period_year", "period_month")
    return versions.next_period(runs)


# Roll-ups


@query
def monthly_rollup(spark, sf_dir):
    return rollup.monthly_rollup(derived.forecast_entries(spark, sf_dir), START, END, "v4")


@query
def monthly_rollup_positive(spark, sf_dir):
    return rollup.monthly_rollup_positive(derived.forecast_entries(spark, sf_dir), START, END, "v4")


@query
def monthly_rollup_horizon(spark, sf_dir):
    registry = derived.forecast_versions(spark, sf_dir)
    return rollup.monthly_rollup_horizon(derived.forecast_entries(spark, sf_dir), registry, "v4")


@query
def actuals_rollup(spark, sf_dir):
    return rollup.actuals_rollup(derived.employee_actuals(spark, sf_dir))


@query
def rollup_grid(spark, sf_dir):
    return rollup.rollup_grid(derived.forecast_entries(spark, sf_dir), START, END, "v4")


@query
def hierarchy_rollup(spark, sf_dir):
    return rollup.hierarchy_rollup(derived.forecast_entries(spark, sf_dir), derived.costcenters(spark, sf_dir), MONTH, "v4")


@query
def subtree_rollup(spark, sf_dir):
    centres = derived.costcenters(spark, sf_dir)
    roots = centres.where("level < 3").select(F.col("id").alias("root_id"))
    return rollup.subtree_rollup(derived.forecast_entries(spark, sf_dir), centres, roots, START, END, "v4")


# Comparisons


@query
def diff_versions_by_cc(spark, sf_dir):
    return diff.diff_versions_by_cc(derived.forecast_entries(spark, sf_dir), "v3", "v4", MONTH)


@query
def diff_versions_by_subject(spark, sf_dir):
    return _wide(diff.diff_versions_by_subject(derived.forecast_entries(spark, sf_dir), "v3", "v4", MONTH), "fte_a", "fte_b")


def _merged_subjects(spark, sf_dir) -> DataFrame:
    """Entries in which thirty customers are one employee, so that most rows overlap."""
    merged = F.concat(F.lit("M"), (F.substring("employee_id", 2, 8).cast("long") / 30).cast("long").cast("string"))
    return derived.forecast_entries(spark, sf_dir).withColumn("employee_id", merged)


@query
def diff_versions_overlapping(spark, sf_dir):
    return _wide(diff.diff_versions_by_subject(_merged_subjects(spark, sf_dir), "v3", "v4", MONTH), "fte_a", "fte_b")


@query
def actuals_mom_delta(spark, sf_dir):
    return diff.actuals_mom_delta(derived.employee_actuals(spark, sf_dir), "RUN-1998-09", "RUN-1998-10")


@query
def actual_vs_forecast(spark, sf_dir):
    actuals, entries = derived.employee_actuals(spark, sf_dir), derived.forecast_entries(spark, sf_dir)
    return diff.actual_vs_forecast(actuals, entries, "RUN-1998-10", "v4", MONTH)


@query
def chain_diff(spark, sf_dir):
    return diff.chain_diff(derived.forecast_entries(spark, sf_dir), derived.forecast_versions(spark, sf_dir), "v4", MONTH)


# Recursion


@query
def hierarchy_tree(spark, sf_dir):
    tree = hierarchy.hierarchy_tree(derived.costcenters(spark, sf_dir))
    return tree.withColumns(
        {"path_ids": F.array_join("path_ids", "/"), "path_names": F.array_join("path_names", "/"), "depth": F.col("depth").cast("long")}
    )


@query
def hierarchy_descendants(spark, sf_dir):
    centres = derived.costcenters(spark, sf_dir)
    return hierarchy.hierarchy_descendants(centres, centres.select(F.col("id").alias("root_id")))


@query
def hierarchy_problems(spark, sf_dir):
    """Each customer below another one by a rule that makes rings; some are roots, some have no such parent."""
    customer = derived.read(spark, sf_dir, "customer")
    n = customer.agg(F.count("*")).scalar()
    key = F.col("c_custkey")
    parent = F.when(key % 41 == 0, F.lit(-1)).when(key % 17 != 0, (key * key + 1) % n)
    nodes = customer.select(
        key.cast("string").alias("id"), parent.cast("string").alias("parent_id"), (F.col("c_acctbal") > -900).alias("is_active")
    )
    return hierarchy.hierarchy_problems(nodes)


@query
def version_chain(spark, sf_dir):
    """Each turn of a conversation follows the one before; walked back from the last turn."""
    turns = derived.read(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()

    def name(turn):
        return F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))

    links = turns.select(name(F.col("turn")).alias("id"), name(F.col("turn") - 1).alias("source_version_id"))
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("turn")).select(name(F.col("turn")).alias("start_id"))
    return hierarchy.version_chain(links, last)


@query
def version_chain_rows(spark, sf_dir):
    """Registry rows of the chain from the working version back to the first."""
    registry = derived.forecast_versions(spark, sf_dir, None, None)
    newest = versions.working_row(registry).id
    return hierarchy.version_chain_rows(registry, newest)


# Lookups and listings


@query
def run_by_id(spark, sf_dir):
    """Runs that have an employee of whole FTE."""
    used = derived.employee_actuals(spark, sf_dir).where("fte = 1").select(F.col("import_run_id").alias("id"))
    return lookup.lookup_by_id(derived.import_runs(spark, sf_dir), used)


@query
def version_by_id(spark, sf_dir):
    """Versions that others were made from, of two years."""
    registry = derived.forecast_versions(spark, sf_dir, None, None)
    asked = registry.where("period_year in (1995, 1997)").select(F.col("source_version_id").alias("id"))
    return lookup.lookup_by_id(registry, asked)


@query
def config_value(spark, sf_dir):
    """Each customer's balance is a setting; one that is no number reads as NULL."""
    settings = derived.read(spark, sf_dir, "customer").select(
        F.concat(F.lit("balance-"), F.col("c_custkey")).alias("key"), F.col("c_acctbal").cast("decimal(38,4)").cast("string").alias("value")
    )
    names = derived.read(spark, sf_dir, "customer").select(F.concat(F.lit("name-"), F.col("c_custkey")).alias("key"), F.col("c_name").alias("value"))
    both = settings.unionByName(names)
    return lookup.config_value(both, "balance-7", "decimal(38,4)").unionByName(lookup.config_value(both, "name-7", "decimal(38,4)"))


@query
def list_employee_groups(spark, sf_dir):
    kinds = derived.read(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.min("o_orderkey").alias("k"))
    code = F.concat(F.lit("EG_"), F.col("o_orderstatus"))
    groups = kinds.select(
        code.alias("id"), code.alias("code"), F.lower(code).alias("label"), (F.col("k") % 100).cast("int").alias("sort_order"),
        (F.col("o_orderstatus") != "P").alias("is_active"),
    )
    return lookup.list_lookups(groups)


@query
def lookup_by_id(spark, sf_dir):
    used = derived.employee_actuals(spark, sf_dir).select(F.col("costcenter_id").alias("id"))
    return lookup.lookup_by_id(derived.costcenters(spark, sf_dir), used)


@query
def resolve_codes(spark, sf_dir):
    rows = derived.read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("CC-"), F.col("o_custkey").cast("string")).alias("code"))
    return lookup.resolve_codes(rows, derived.costcenters(spark, sf_dir), "code", "costcenter_id")


@query
def run_by_period(spark, sf_dir):
    return lookup.run_by_period(derived.import_runs(spark, sf_dir), derived.forecast_versions(spark, sf_dir))


@query
def working_version(spark, sf_dir):
    return lookup.working_version(derived.forecast_versions(spark, sf_dir, None, None))


@query
def list_versions(spark, sf_dir):
    return lookup.list_versions(derived.forecast_versions(spark, sf_dir, None, None))


@query
def actuals_history(spark, sf_dir):
    actuals = derived.employee_actuals(spark, sf_dir).drop("period_start")
    return _wide(lookup.actuals_history(actuals, derived.import_runs(spark, sf_dir)), "fte").drop("import_run_id")


@query
def latest_completed_run(spark, sf_dir):
    return lookup.latest_completed_run(derived.import_runs(spark, sf_dir))


@query
def list_import_runs(spark, sf_dir):
    return lookup.list_import_runs(derived.import_runs(spark, sf_dir))


@query
def list_active_costcenters(spark, sf_dir):
    return lookup.list_active_costcenters(derived.costcenters(spark, sf_dir))


@query
def list_lookups(spark, sf_dir):
    kinds = derived.read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.max("o_orderstatus").alias("s"))
    types = kinds.select(
        F.concat(F.lit("ct-"), F.substring("o_orderpriority", 1, 1)).alias("id"),
        F.col("o_orderpriority").alias("code"),
        F.lower("o_orderpriority").alias("label"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("sort_order"),
        (F.col("o_orderpriority") != "5-LOW").alias("is_active"),
    )
    return lookup.list_lookups(types)


# Changes


def _feed(spark, sf_dir, containers=None):
    return derived.change_feed(derived.read(spark, sf_dir, "events"), containers)


def _rows(df: DataFrame) -> DataFrame:
    """Comparable form of SCD2 rows."""
    return df.select(
        subject_kind().alias("subject_kind"),
        subject_key().alias("subject_key"),
        "costcenter_id",
        F.col("fte").cast("decimal(38,4)").alias("fte"),
        "valid_from",
        "valid_to",
        "is_deleted",
        "deleted_by",
        "created_by",
    )


@query
def scd2_apply(spark, sf_dir):
    return _rows(scd2.scd2_apply(None, _feed(spark, sf_dir)).inserted)


@query
def scd2_rejects(spark, sf_dir):
    rejects = scd2.scd2_apply(None, _feed(spark, sf_dir)).rejects
    return rejects.select(subject_key().alias("subject_key"), "seq", "valid_from", "reason")


@query
def scd2_apply_container(spark, sf_dir):
    return _rows(scd2.scd2_apply(None, _feed(spark, sf_dir, containers=True)).inserted)


@query
def scd2_close(spark, sf_dir):
    return _rows(scd2.scd2_close(scd2.scd2_apply(None, _feed(spark, sf_dir))))


def _with_id_counts(df: DataFrame) -> DataFrame:
    """The rows with the number of rows that have the same id."""
    return df.withColumn("n_same_id", F.count("*").over(Window.partitionBy("id")))


def _full_rows(df: DataFrame, *more: str) -> DataFrame:
    """All columns of SCD2 rows but the id."""
    rest = ["first_name", "last_name", "classification_id", "employee_group_id", "job_description"]
    return df.select(
        subject_kind().alias("subject_kind"), subject_key().alias("subject_key"), "costcenter_id", F.col("fte").cast("decimal(38,4)").alias("fte"),
        "valid_from", "valid_to", "is_deleted", "deleted_by", "created_by", *rest, _time("deleted_at"), _time("created_at"), *more,
    )


def _stored_changes(spark, sf_dir, jobs=("second", "second")) -> str:
    """Root of a table made by two batches. The second delivers a quarter of the feed again and is
    repeated as a job; another name for it delivers all of its changes once more."""
    root, feed = _scratch(spark, "stored-changes"), _feed(spark, sf_dir)
    quarter = feed.agg(F.floor(F.max("seq") / 4)).first()[0]
    change_stream.apply_change_batch(feed.where(F.col("seq") <= 2 * quarter), "first", root, buckets=8, feed="feed")
    later = feed.where(F.col("seq") > quarter)
    for job in jobs:
        change_stream.apply_change_batch(later, job, root, buckets=8, feed="feed")
    return root


@query
def stored_changes(spark, sf_dir):
    return _full_rows(_with_id_counts(change_stream.read_entries(spark, _stored_changes(spark, sf_dir))), "n_same_id")


@query
def stored_changes_audit(spark, sf_dir):
    root = _stored_changes(spark, sf_dir)
    records = _with_id_counts(change_stream.read_audit(spark, root))
    fields = audit.audit_explode(records).select("id", "field", "old", "new")
    entries = change_stream.read_entries(spark, root).select(
        F.col("id").alias("forecast_entry_id"), subject_key().alias("subject_key"), "valid_from", _time("created_at")
    )
    rows = records.join(fields, "id", "left").join(entries, "forecast_entry_id")
    return rows.select("subject_key", "valid_from", "created_at", "action", "field", "old", "new", "changed_by", _time("changed_at"), "n_same_id")


@query
def stored_changes_rejects(spark, sf_dir):
    rejects = change_stream.read_rejects(spark, _stored_changes(spark, sf_dir, ("second", "again")))
    return rejects.select(subject_key().alias("subject_key"), "seq", "valid_from", "reason")


@query
def stream_stored_changes(spark, sf_dir):
    """A table that was kept elsewhere takes two runs of a stream and then a batch job."""
    root, feed = _scratch(spark, "stream-stored"), _feed(spark, sf_dir)
    quarter = feed.agg(F.floor(F.max("seq") / 4)).first()[0]
    first = scd2.scd2_apply(None, feed.where(F.col("seq") <= quarter), feed="feed").materialized()
    change_stream.start_store(first.final, f"{root}/table", buckets=8)
    for part in (1, 2):
        due = feed.where((F.col("seq") > part * quarter) & (F.col("seq") <= (part + 1) * quarter))
        due.write.mode("append").parquet(f"{root}/drop")
        stream = spark.readStream.schema(feed.schema).parquet(f"{root}/drop")
        change_stream.stream_scd2(stream, f"{root}/table", f"{root}/progress", buckets=8, feed="feed").awaitTermination()
    change_stream.apply_change_batch(feed.where(F.col("seq") > 3 * quarter), "rest", f"{root}/table", buckets=8, feed="feed")
    return _full_rows(change_stream.read_entries(spark, f"{root}/table"))


def _debt_requests(spark, sf_dir) -> DataFrame:
    """Customers in debt leave the working version."""
    debt = derived.read(spark, sf_dir, "customer").where("c_acctbal < 0")
    key = F.lpad(F.col("c_custkey").cast("string"), 8, "0")
    container = F.col("c_custkey") % 10 == 0
    return debt.select(
        F.lit("v4").alias("version_id"),
        F.when(~container, F.concat(F.lit("C"), key)).alias("employee_id"),
        F.when(container, F.concat(F.lit("P"), key)).alias("container_id"),
        F.lit("auditor").alias("deleted_by"),
        F.lit(NOW).alias("deleted_at"),
    )


@query
def publish_soft_delete(spark, sf_dir):
    """Audit of a published soft delete whose job failed once half-way and was then run twice."""
    root = _scratch(spark, "soft-delete")
    write_table(derived.full_entries(spark, sf_dir), root, "forecast_entries")
    requests = _debt_requests(spark, sf_dir)
    publish.append_audit(scd2.soft_delete(read_table(spark, root, "forecast_entries"), requests).audit(), root)
    for _ in range(2):
        done = scd2.soft_delete(read_table(spark, root, "forecast_entries"), requests)
        publish.publish_flagged(done, root, f"{root}/staging")
    gone = read_table(spark, root, "forecast_entries").where("is_deleted and deleted_by = 'auditor'").select(F.col("id").alias("forecast_entry_id"))
    records = read_table(spark, root, "forecast_entry_audit").join(gone, "forecast_entry_id")
    return records.groupBy("forecast_entry_id", "version_id", "action", "changed_by").agg(F.count("*").alias("n_records"))


@query
def soft_delete(spark, sf_dir):
    entries = derived.full_entries(spark, sf_dir)
    after = scd2.soft_delete(entries, _debt_requests(spark, sf_dir)).merge_into(entries)
    return after.select("id", "version_id", "valid_from", "valid_to", "is_deleted", "deleted_by")


@query
def restore(spark, sf_dir):
    """Every row that the feed deleted is asked back; subjects with an open row refuse."""
    entries = scd2.scd2_apply(None, _feed(spark, sf_dir)).materialized().inserted
    asked = entries.where("is_deleted").select("id")
    return _rows(scd2.restore(entries, asked).after)


@query
def rollover_seed(spark, sf_dir):
    seeded = versions.seed_rows(derived.full_entries(spark, sf_dir), "v4", "v5", "1998-02-01", "planner", NOW)
    columns = ["source_entry_id", "version_id", "employee_id", "container_id", "costcenter_id", "classification_id", "employee_group_id", "fte", "valid_from", "valid_to", "is_deleted"]
    return _wide(seeded.select(*columns), "fte")


@query
def rollover_published(spark, sf_dir):
    """Registry, new rows and their audit after a rollover that was published twice."""
    root, entries = _scratch(spark, "rollover"), derived.full_entries(spark, sf_dir)
    write_table(entries, root, "forecast_entries")
    registry = conform(derived.forecast_versions(spark, sf_dir), "forecast_versions")
    for _ in range(2):
        done = versions.rollover(read_table(spark, root, "forecast_entries"), registry, "FC 1998-02", "1998-02-01", 18, "planner", NOW)
        publish.publish_rollover(done, root)
    found = publish.read_generation(spark, root, "forecast_versions")
    period = (F.col("period_year") * 100 + F.col("period_month")).cast("string")
    listed = found.select(
        F.lit("version").alias("part"), F.col("label").alias("key"), F.col("status").alias("what"), period.alias("month"),
        F.col("source_version_id").alias("parent"), F.coalesce("archived_by", "created_by").alias("who"), F.lit(None).cast("decimal(38,4)").alias("fte"),
    )
    fresh = read_table(spark, root, "forecast_entries").where(F.col("version_id") == done.version_id)
    rows = fresh.select(
        F.lit("entry").alias("part"), subject_key().alias("key"), F.col("costcenter_id").alias("what"), F.col("valid_from").cast("string").alias("month"),
        F.col("valid_to").cast("string").alias("parent"), F.col("created_by").alias("who"), F.col("fte").cast("decimal(38,4)").alias("fte"),
    )
    names = fresh.select(F.col("id").alias("forecast_entry_id"), subject_key().alias("key"))
    records = read_table(spark, root, "forecast_entry_audit").join(names, "forecast_entry_id").select(
        F.lit("audit").alias("part"), "key", F.col("action").alias("what"), F.lit(None).cast("string").alias("month"),
        F.lit(None).cast("string").alias("parent"), F.col("changed_by").alias("who"), F.lit(None).cast("decimal(38,4)").alias("fte"),
    )
    return listed.unionByName(rows).unionByName(records)


@query
def first_version(spark, sf_dir):
    """Asked for a working version: a registry without one gets its first, any other stays."""
    archived = conform(derived.forecast_versions(spark, sf_dir).where("status = 'archived'"), "forecast_versions")
    whole = conform(derived.forecast_versions(spark, sf_dir), "forecast_versions")
    parts = [versions.get_or_create_working(registry, "first", "1999-02-01", 12, "planner", NOW) for registry in (archived, whole)]
    columns = ["label", "status", "period_year", "period_month", "fc_horizon_months", "source_version_id", "created_by"]
    found = parts[0].select(F.lit("made").alias("case"), *columns).unionByName(parts[1].select(F.lit("kept").alias("case"), *columns))
    return found.withColumns({c: F.col(c).cast("int") for c in ("period_year", "period_month", "fc_horizon_months")})


@query
def rollover_not_copied(spark, sf_dir):
    rows = versions.rows_left_behind(derived.forecast_entries(spark, sf_dir), "v4", "1998-02-01")
    return rows.select("id", "valid_from", "valid_to")


@query
def upsert(spark, sf_dir):
    """Customers hold one setting each, which their orders change; suppliers add new ones, named twice."""
    config = derived.read(spark, sf_dir, "customer").select(
        F.concat(F.lit("c-"), F.col("c_custkey").cast("string")).alias("key"),
        F.col("c_mktsegment").alias("value"),
        F.col("c_name").alias("description"),
        F.lit(None).cast("string").alias("updated_by"),
        F.lit(None).cast("long").alias("updated_seq"),
    )
    orders = derived.read(spark, sf_dir, "orders").select(
        F.concat(F.lit("c-"), F.col("o_custkey").cast("string")).alias("key"),
        F.col("o_orderpriority").alias("value"),
        F.lit("from an order").alias("description"),
        F.concat(F.lit("o-"), F.col("o_orderkey").cast("string")).alias("updated_by"),
        F.col("o_orderkey").alias("updated_seq"),
    )
    suppliers = derived.read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s-"), F.col("s_suppkey").cast("string")).alias("key"),
        F.col("s_name").alias("value"),
        F.lit("from a supplier").alias("description"),
        F.lit(None).cast("string").alias("updated_by"),
        F.col("s_suppkey").alias("updated_seq"),
    )
    again = suppliers.withColumns(
        {
            "value": F.concat(F.col("value"), F.lit(" again")),
            "description": F.lit("from a supplier again"),
            "updated_seq": F.col("updated_seq") + 1_000_000_000,
        }
    )
    batch = orders.unionByName(suppliers).unionByName(again)
    return upserts.upsert(config, batch, "key", ["value", "updated_by", "updated_seq"], "updated_seq")


# Audit


@query
def audit_diff(spark, sf_dir):
    """Rows of one version against the next, matched by order, in long form; of a removed row, parts of its snapshot."""
    entries = derived.forecast_entries(spark, sf_dir)
    order = F.substring_index("id", "-", -1).alias("order_id")
    before = entries.where("version_id = 'v3'").withColumn("order_id", order)
    after = entries.where("version_id = 'v4'").withColumn("order_id", order)
    records = audit.audit_diff(before, after, "planner", F.lit(NOW), key="order_id")
    kinds = {"id": "string", "costcenter_id": "string", "fte": "decimal(38,4)", "valid_from": "string", "is_deleted": "string"}
    parts = [F.get_json_object("old", f"$.{c}").cast(kind).cast("string") for c, kind in kinds.items()]
    old = F.when(F.col("field") == audit.SNAPSHOT, F.concat_ws("|", *parts)).otherwise(F.col("old"))
    fields = audit.audit_explode(records).select("forecast_entry_id", "action", "field", old.alias("old"), "new")
    inserted = records.where("action = 'INSERT'").select(
        "forecast_entry_id", "action", *[F.lit(None).cast("string").alias(c) for c in ("field", "old", "new")]
    )
    return fields.unionByName(inserted)


def _feed_audit(spark, sf_dir):
    return scd2.scd2_apply(None, _feed(spark, sf_dir)).materialized()


def _subject_of(records: DataFrame, entries: DataFrame) -> DataFrame:
    """Records with the subject and start of their entry instead of its id."""
    names = entries.select(F.col("id").alias("forecast_entry_id"), subject_key().alias("subject_key"), "valid_from")
    return records.join(names, "forecast_entry_id").drop("forecast_entry_id")


@query
def audit_explode(spark, sf_dir):
    done = _feed_audit(spark, sf_dir)
    fields = audit.audit_explode(audit.changed_fields_json(done.audit))
    return _subject_of(fields, done.inserted).select("subject_key", "valid_from", "action", "field", "old", "new")


@query
def audit_entry_history(spark, sf_dir):
    """History of the entries that ended deleted."""
    done = _feed_audit(spark, sf_dir)
    gone = done.inserted.where("is_deleted").select(F.col("id").alias("forecast_entry_id"))
    history = audit.audit_entry_history(done.audit, gone)
    return _subject_of(history, done.inserted).select("subject_key", "valid_from", "action", "changed_by", _time("changed_at"))


@query
def audit_version_feed(spark, sf_dir):
    done = _feed_audit(spark, sf_dir)
    top = audit.audit_version_feed(done.audit, done.inserted, "feed", FEED_SIZE)
    return top.select(
        "forecast_entry_id", "action", "changed_by", "employee_id", "container_id", "costcenter_id", _time("changed_at")
    )


# Data quality


@query
def dq_unique(spark, sf_dir):
    lines, orders = derived.read(spark, sf_dir, "lineitem"), derived.read(spark, sf_dir, "orders")
    actuals, runs = derived.employee_actuals(spark, sf_dir), cut(derived.import_runs(spark, sf_dir))
    return quality.union_all(
        [
            quality.dq_unique(lines, "lineitem_key", ["l_orderkey", "l_linenumber"]),
            quality.dq_unique(orders, "orders_key", ["o_orderkey"]),
            quality.dq_unique(actuals, "actuals_run_employee", ["import_run_id", "employee_id"], sizes=orders),
            quality.dq_unique(runs, "runs_period", ["period_year", "period_month"]),
        ]
    )


@query
def dq_one_working(spark, sf_dir):
    """Months with open orders count as working, so the rule is broken."""
    orders = derived.read(spark, sf_dir, "orders")
    month = F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("id")
    status = F.when(F.max(F.col("o_orderstatus") == "O"), "working").otherwise("archived").alias("status")
    return quality.dq_one_working(orders.groupBy(month).agg(status))


@query
def dq_checks(spark, sf_dir):
    entries = derived.forecast_entries(spark, sf_dir).withColumns(
        {"deleted_at": F.lit(None).cast("timestamp"), "deleted_by": F.lit(None).cast("string")}
    )
    lines = derived.read(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"),
        (F.col("l_quantity") * 0.25).cast("decimal(6,4)").alias("fte"),
    )
    runs, registry = derived.import_runs(spark, sf_dir), derived.forecast_versions(spark, sf_dir, None, None)
    registry = registry.withColumns({"archived_at": F.lit(None).cast("timestamp"), "archived_by": F.lit(None).cast("string")})
    return quality.union_all(
        [
            quality.dq_checks(entries, CHECKS["forecast_entries"]),
            quality.dq_checks(lines, CHECKS["employee_actuals"]),
            quality.dq_checks(runs, CHECKS["import_runs"]),
            quality.dq_checks(registry, CHECKS["forecast_versions"]),
        ]
    )


@query
def dq_foreign_keys(spark, sf_dir):
    entries, actuals = derived.forecast_entries(spark, sf_dir), derived.employee_actuals(spark, sf_dir)
    active = derived.costcenters(spark, sf_dir).where("is_active")
    solvent = derived.read(spark, sf_dir, "customer").where("c_acctbal >= 0")
    employees = solvent.select(F.concat(F.lit("C"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("id"))
    registry = derived.forecast_versions(spark, sf_dir)
    return quality.union_all(
        [
            quality.dq_foreign_keys(entries, "costcenter_id", active, "id", "entries_costcenter"),
            quality.dq_foreign_keys(entries, "employee_id", employees, "id", "entries_employee"),
            quality.dq_foreign_keys(entries, "version_id", registry, "id", "entries_version"),
            quality.dq_foreign_keys(actuals, "employee_id", employees, "id", "actuals_employee"),
        ]
    )


@query
def dq_rules(spark, sf_dir):
    """All keys, references and row rules of the twelve tables, each with planted faults."""
    given = {name: derived.read(spark, sf_dir, name) for name in SOURCES}
    tables = {name: spark.sql(text, **{n: df for n, df in given.items() if f"{{{n}}}" in text}) for name, text in RULE_TABLES.items()}
    return rules.check_rules(tables)


@query
def dq_overlap(spark, sf_dir):
    """Each order as a three-month assignment of its customer."""
    orders = derived.read(spark, sf_dir, "orders")
    start = F.trunc(F.col("o_orderdate").cast("date"), "MM")
    rows = orders.select(
        F.col("o_orderkey").alias("id"),
        F.lit("orders").alias("version_id"),
        F.col("o_custkey").cast("string").alias("employee_id"),
        F.lit(None).cast("string").alias("container_id"),
        start.alias("valid_from"),
        F.add_months(start, 3).alias("valid_to"),
        F.lit(False).alias("is_deleted"),
    )
    return quality.dq_overlap(rows)


@query
def dq_immutable(spark, sf_dir):
    """Actuals against a later state in which one employee group was dropped."""
    before = _wide(derived.employee_actuals(spark, sf_dir), "fte")
    group = F.when(F.col("employee_group_id") != "EG_F", F.col("employee_group_id"))
    after = before.withColumn("employee_group_id", group)
    return quality.dq_immutable(before, after, before.columns, "import_run_id")


@query
def dq_immutable_audit(spark, sf_dir):
    """Audit records, a version for each day, against a later log: some records of eight days are lost or altered, others appended."""
    events = derived.read(spark, sf_dir, "events")
    fields = F.create_map(F.lit("fte"), F.struct(F.lit(None).cast("string").alias("old"), F.col("value").cast("string").alias("new")))
    before = events.select(
        F.col("event_id").cast("string").alias("id"), F.dayofmonth("ts").cast("string").alias("version_id"), F.col("event_type").alias("action"),
        F.col("user_id").cast("string").alias("changed_by"), fields.alias("changed_fields"), F.col("event_id").alias("n"),
    )
    touched = F.col("version_id").cast("int") <= 8
    after = before.where(~(touched & (F.col("n") % 50 == 0)))
    other = F.create_map(F.lit("fte"), F.struct(F.lit(None).cast("string").alias("old"), F.lit("other").alias("new")))
    after = after.withColumn("changed_fields", F.when(touched & (F.col("n") % 70 == 1), other).otherwise(F.col("changed_fields")))
    after = after.unionByName(before.where("n % 90 = 2").withColumn("id", F.concat(F.lit("more "), F.col("id"))))
    found = quality.dq_immutable(before.drop("n"), after.drop("n"), before.drop("n").columns, "version_id")
    return found.drop("changed_fields")


# Ingest


def _import_rows(spark, sf_dir):
    actuals = derived.employee_actuals(spark, sf_dir)
    return actuals.select(
        "employee_id", "costcenter_id", "classification_id", "employee_group_id", "fte",
        F.year("period_start").cast("short").alias("period_year"),
        F.month("period_start").cast("short").alias("period_month"),
    )


@query
def read_import_file(spark, sf_dir):
    """Orders written as an import file in which one status has no valid FTE."""
    orders = derived.read(spark, sf_dir, "orders").select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("employee_id"),
        F.col("o_orderpriority").alias("first_name"),
        F.col("o_orderkey").cast("string").alias("last_name"),
        F.col("o_orderstatus").alias("costcenter_id"),
        F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(((F.col("o_orderkey") % 8 + 1) * 0.125).cast("decimal(6,4)").cast("string")).alias("fte"),
    )
    path = _scratch(spark, "import-file")
    write_json(orders, path)
    found = imports.read_import_file(spark, path, "json")
    good = found.rows.select(F.lit("loaded").alias("outcome"), F.col("last_name").alias("order_id"), F.col("fte").cast("decimal(38,4)").alias("fte"))
    bad = found.quarantine.select(
        F.lit("quarantined").alias("outcome"),
        F.get_json_object("line", "$.last_name").alias("order_id"),
        F.lit(None).cast("decimal(38,4)").alias("fte"),
    )
    return good.unionByName(bad)


@query
def read_csv_file(spark, sf_dir):
    """Orders written as CSV with line breaks and quotes in a name, in which one status has no valid FTE."""
    orders = derived.read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("last_name"),
        F.concat(F.col("o_orderpriority"), F.lit('\nthe "'), F.col("o_orderstatus"), F.lit('", and')).alias("first_name"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("employee_id"),
        F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(((F.col("o_orderkey") % 8 + 1) * 0.125).cast("decimal(6,4)").cast("string")).alias("fte"),
    )
    path = _scratch(spark, "csv-file")
    orders.write.csv(path, header=True, quoteAll=True, escape='"')
    found = imports.read_import_file(spark, path, "csv")
    values = [F.col(c) for c in ("employee_id", "first_name", "last_name")]
    good = found.rows.select(F.to_json(F.struct(*values)).alias("content"), F.col("fte").cast("decimal(38,4)").alias("fte"))
    return good.unionByName(found.quarantine.select(F.col("line").alias("content"), F.lit(None).cast("decimal(38,4)").alias("fte")))


@query
def import_actuals(spark, sf_dir):
    """All months are offered; those before 1999 were imported already."""
    existing = derived.import_runs(spark, sf_dir).where("period_year < 1999")
    load = imports.import_actuals(existing, _import_rows(spark, sf_dir), "importer", NOW)
    period = ["period_year", "period_month"]
    loaded = load.runs.select(*period, F.lit("loaded").alias("outcome"), F.col("row_count").cast("long").alias("n_rows"))
    refused = load.refused.groupBy(*period).agg(F.count("*").alias("n_rows")).withColumn("outcome", F.lit("refused"))
    return loaded.unionByName(refused).withColumns({c: F.col(c).cast("int") for c in period})


@query
def import_run_counts(spark, sf_dir):
    runs = derived.import_runs(spark, sf_dir).drop("row_count")
    return imports.import_run_counts(runs, derived.employee_actuals(spark, sf_dir))


# Streaming


@query
def stream_scd2(spark, sf_dir):
    events = derived.read(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    root = _scratch(spark, "stream-scd2")
    change_stream.stream_scd2(derived.change_feed(stream), f"{root}/table", f"{root}/progress", buckets=8).awaitTermination()
    return _rows(change_stream.read_entries(spark, f"{root}/table"))


def _drop_rows(spark, sf_dir) -> DataFrame:
    """Import rows as they are dropped, ten years later, since periods begin with 2000."""
    rows = _import_rows(spark, sf_dir).withColumns({c: F.col("employee_id") for c in ("first_name", "last_name")})
    return rows.withColumn("period_year", (F.col("period_year") + 10).cast("short"))


@query
def stream_import(spark, sf_dir):
    root = _scratch(spark, "stream-import")
    write_json(_drop_rows(spark, sf_dir), f"{root}/drop")
    rows = import_stream.read_drop_folder(spark, f"{root}/drop")
    import_stream.stream_import(rows, f"{root}/table", f"{root}/progress", "importer", NOW).awaitTermination()
    runs = import_stream.read_loaded(spark, f"{root}/table", "import_runs")
    return runs.select(F.col("period_year").cast("int"), F.col("period_month").cast("int"), "status", F.col("row_count").cast("int"))


@query
def stream_import_held(spark, sf_dir):
    """Months come in two drops, half of the employees each, and end markers with the second.

    Those of 2009 or later expect a row more than there is and stay open; a line for each fiftieth
    customer names a period that does not exist.
    """
    root = _scratch(spark, "stream-held")
    rows = _drop_rows(spark, sf_dir)
    customer = derived.read(spark, sf_dir, "customer").where("c_custkey % 50 = 0")
    name = F.concat(F.lit("C"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))
    bad = customer.select(
        *[name.alias(c) for c in ("employee_id", "first_name", "last_name", "costcenter_id")],
        F.lit("1.0").cast("decimal(6,4)").alias("fte"), F.lit(1950).alias("period_year"), F.lit(13).alias("period_month"),
    )
    late = (F.col("period_year") >= 2009).cast("int")
    markers = rows.groupBy("period_year", "period_month").agg(F.count("*").alias("n")).select(
        "period_year", "period_month", (F.col("n") + late).cast("int").alias("expected_rows")
    )
    odd = F.substring("employee_id", -1, 1).cast("int") % 2
    write_json(rows.where(odd == 0).unionByName(bad, allowMissingColumns=True), f"{root}/first")
    write_json(rows.where(odd == 1).unionByName(markers, allowMissingColumns=True), f"{root}/second")
    for batch, part in enumerate(("first", "second")):
        lines = spark.read.text(f"{root}/{part}")
        import_stream.load_drop_batch(lines, batch, f"{root}/table", "importer", NOW, hold=True)
    runs = import_stream.read_loaded(spark, f"{root}/table", "import_runs").select(F.col("id").alias("import_run_id"), "period_year", "period_month")
    actuals = import_stream.read_loaded(spark, f"{root}/table", "employee_actuals").join(runs, "import_run_id")
    columns = ["employee_id", "costcenter_id", "classification_id", "employee_group_id", "fte", "period_year", "period_month"]
    loaded = actuals.select(F.lit("loaded").alias("outcome"), *columns)
    aside = import_stream.quarantined(spark, f"{root}/table")
    aside = aside.select(F.col("reason").alias("outcome"), F.get_json_object("line", "$.employee_id").alias("employee_id"), "period_year", "period_month")
    waiting = import_stream.open_months(spark, f"{root}/table").select(
        F.concat(F.lit("open "), F.col("n_rows"), F.lit(" of "), F.col("expected_rows")).alias("outcome"), "period_year", "period_month"
    )
    found = loaded.unionByName(aside, allowMissingColumns=True).unionByName(waiting, allowMissingColumns=True)
    return _wide(found, "fte").withColumns({c: F.col(c).cast("int") for c in ("period_year", "period_month")})
