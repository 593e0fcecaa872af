"""Batch application of changes and soft deletes to versioned rows (SCD type 2).

One change closes the open row of its subject at the change's month and opens a new
row. A batch holds many changes per subject; ``seq`` gives their order. The result
equals applying them one by one:

* a change whose month is not after the start of the open row is rejected;
* a delete flags the open row and leaves ``valid_to`` NULL; without an open row it
  does nothing;
* after a delete there is no open row, so any month is accepted, earlier ones too.

A feed may deliver a change again or late. ``marks`` hold the highest ``seq`` of each subject
that was delivered before: a change not above its subject's mark was applied, or its turn has
passed, and is rejected. So a batch that is repeated changes nothing, whatever was in it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from headgrid.functions.keys import SUBJECT, hashed_id, join_on
from headgrid.functions.temporal import is_open
from headgrid.operators.audit import audit_record, field_change
from headgrid.operators.blocks import SPLIT_ROWS, split_hot_keys
from headgrid.session import broadcast_if_small, cut

PAYLOAD = (
    "first_name",
    "last_name",
    "costcenter_id",
    "classification_id",
    "employee_group_id",
    "job_description",
    "fte",
)
STATE_COLUMNS = ("valid_from", "valid_to", "is_deleted", "deleted_at", "deleted_by", "created_by", "created_at")


@dataclass
class ChangeSet:
    """What a batch does to a table.

    ``work`` holds every change and every stored open row of a changed subject, with
    its outcome: ``kept`` marks rows of the table, ``stored`` those that were there
    before, ``reason`` the rejected changes, and ``next_*`` names the change that
    closed or deleted the row.
    """

    keys: list[str]
    payload: list[str]
    work: DataFrame

    @property
    def columns(self) -> list[str]:
        return ["id", *self.keys, *self.payload, *STATE_COLUMNS]

    @property
    def rows(self) -> DataFrame:
        return self.work.where("kept")

    @property
    def rejects(self) -> DataFrame:
        return self.work.where(F.col("reason").isNotNull()).select(*self.keys, "seq", "valid_from", "reason")

    @property
    def marks(self) -> DataFrame:
        """The highest sequence number of each subject in the batch, rejected changes included."""
        seen = self.work.where(~F.col("stored") & F.col("seq").isNotNull())
        return seen.groupBy(*self.keys).agg(F.max("seq").alias("last_seq"))

    @property
    def inserted(self) -> DataFrame:
        return self.rows.where(~F.col("stored")).select(*self.columns)

    @property
    def updated(self) -> DataFrame:
        """Stored rows that the batch closed or deleted."""
        ended = F.col("stored") & F.col("next_seq").isNotNull()
        return self.rows.where(ended).select(*self.columns)

    @property
    def final(self) -> DataFrame:
        return self.rows.select(*self.columns)

    @property
    def audit(self) -> DataFrame:
        """INSERT for each new row, UPDATE for each close, DELETE for each soft delete."""
        key = [F.col("id").alias("forecast_entry_id")]
        version = F.col("version_id") if "version_id" in self.keys else F.lit(None).cast("string")
        inserts = self.rows.where(~F.col("stored")).select(
            *key, version.alias("version_id"), F.lit("INSERT").alias("action"),
            F.lit(None).cast("map<string,struct<old:string,new:string>>").alias("changed_fields"),
            F.col("created_by").alias("changed_by"), F.col("created_at").alias("changed_at"),
        )
        ended = self.rows.where(F.col("next_seq").isNotNull())
        changed = F.when(
            F.col("is_deleted"), field_change("is_deleted", F.lit("false"), F.lit("true"))
        ).otherwise(field_change("valid_to", F.lit(None).cast("string"), F.col("valid_to").cast("string")))
        ends = ended.select(
            *key, version.alias("version_id"),
            F.when(F.col("is_deleted"), "DELETE").otherwise("UPDATE").alias("action"),
            changed.alias("changed_fields"),
            F.col("next_by").alias("changed_by"), F.col("next_at").alias("changed_at"),
        )
        return audit_record(inserts.unionByName(ends))

    def materialized(self) -> "ChangeSet":
        """The same set computed once; its size is that of the batch, not of the table."""
        return ChangeSet(self.keys, self.payload, cut(self.work))

    def merge_into(self, entries: DataFrame) -> DataFrame:
        """The whole table after the batch. Rows that are not open pass through unjoined."""
        ended = self.updated.select("id")
        settled = entries.where(~is_open())
        untouched = entries.where(is_open()).join(ended, "id", "left_anti")
        columns = [c for c in entries.columns if c in self.columns]
        kept = settled.unionByName(untouched).select(*columns)
        return kept.unionByName(self.updated.select(*columns)).unionByName(self.inserted.select(*columns))


def _invalid(keys: list[str], payload: list[str]):
    """Reason why a change can never be stored, or NULL."""
    is_set = F.col("op") == "set"
    checks = [
        (F.col("changed_by").isNull(), "missing_actor"),
        (F.col("op").isNull() | ~F.col("op").isin("set", "delete"), "unknown_op"),
        (F.col("seq").isNull(), "missing_seq"),
        (is_set & (F.col("valid_from").isNull() | (F.dayofmonth("valid_from") != 1)), "valid_from_not_month_start"),
    ]
    if {"employee_id", "container_id"} <= set(keys):
        checks.append((F.col("employee_id").isNull() == F.col("container_id").isNull(), "subject_not_exclusive"))
    for name in ("first_name", "last_name", "costcenter_id", "fte"):
        if name in payload:
            checks.append((is_set & F.col(name).isNull(), f"missing_{name}"))
    reason = F.lit(None).cast("string")
    for condition, name in reversed(checks):
        reason = F.when(condition, name).otherwise(reason)
    return reason


def scd2_apply(
    entries: DataFrame | None,
    changes: DataFrame,
    keys=SUBJECT,
    payload=PAYLOAD,
    split_rows: int = SPLIT_ROWS,
    marks: DataFrame | None = None,
    feed: str = "",
) -> ChangeSet:
    """Apply a batch of changes; see the module text for the rules.

    ``changes`` has the keys, ``seq``, ``op`` (``set`` or ``delete``), ``valid_from``, the
    payload, ``changed_by`` and ``changed_at``. Of changes of a subject with the same ``seq``
    one counts and the others are rejected. ``marks`` has the keys and ``last_seq``. The ids of
    new rows are made of ``feed``, subject and ``seq``: with marks they are unique over all
    batches of the feed; without them a feed that numbers from the start again needs another name.
    Employees and containers use the same call: the key names both columns and one
    of them is NULL. Only open rows of changed subjects are read from ``entries``; a
    subject has one at most.

    Per subject in ``seq`` order, a segment runs up to a delete. Within a segment a
    change is accepted exactly if its month is after all earlier months of the
    segment: rejected rows never exceed the running maximum, so the maximum over all
    rows equals that over the accepted ones. Subjects with more than ``split_rows``
    changes are worked on in blocks.
    """
    keys, payload = list(keys), list(payload)
    valid = F.col("reason").isNull()
    rows = changes.select(
        *keys,
        F.lit(False).alias("stored"),
        F.col("seq").cast("long").alias("seq"),
        "op",
        "valid_from",
        hashed_id(F.lit(feed), *keys, "valid_from", "seq").alias("id"),
        *payload,
        "changed_by",
        "changed_at",
        _invalid(keys, payload).alias("reason"),
    )
    if marks is not None:
        rows = _refuse_delivered(rows, marks, keys)
    # An invalid change stays in the stream without an effect: no delete, no month.
    rows = rows.withColumns(
        {
            "is_del": valid & (F.col("op") == "delete"),
            "month": F.when(valid & (F.col("op") == "set"), F.col("valid_from")),
        }
    ).drop("op")
    sizes = rows
    if entries is not None:
        touched = rows.where(valid).select(*keys).distinct()
        stored = join_on(entries.where(is_open()), touched, keys, "left_semi").select(
            *keys,
            F.lit(True).alias("stored"),
            F.lit(-1).cast("long").alias("seq"),
            F.lit(False).alias("is_del"),
            "valid_from",
            F.col("valid_from").alias("month"),
            "id",
            *payload,
            F.col("created_by").alias("changed_by"),
            F.col("created_at").alias("changed_at"),
            F.lit(None).cast("string").alias("reason"),
        )
        rows = rows.unionByName(stored)
    rows = rows.withColumn("turn", F.when(F.col("stored"), 0).otherwise(1))

    order = ["turn", "seq", "id"]
    # Blocks are cut between sequence numbers, so that repeated ones meet.
    rows, was_split = split_hot_keys(rows, keys, order[:2], split_rows, sizes)
    unit = [*keys, "block"]
    by_order = Window.partitionBy(*unit).orderBy(*order)
    again = ~F.col("stored") & (F.lag("seq").over(by_order) == F.col("seq"))
    rows = rows.withColumn("again", F.coalesce(again, F.lit(False))).withColumns(
        {
            "is_del": F.col("is_del") & ~F.col("again"),
            "month": F.when(~F.col("again"), F.col("month")),
            "reason": F.coalesce("reason", F.when(F.col("again"), "repeated_seq")),
        }
    ).drop("again")
    before = (Window.unboundedPreceding, -1)
    rows = rows.withColumn(
        "segment", F.coalesce(F.sum(F.col("is_del").cast("int")).over(by_order.rowsBetween(*before)), F.lit(0))
    )
    in_segment = Window.partitionBy(*unit, "segment").orderBy(*order)
    rows = rows.withColumn("reached", F.max("month").over(in_segment.rowsBetween(*before)))
    if was_split:
        rows = _carry_in(rows, keys)
    late_enough = F.col("stored") | F.col("reached").isNull() | (F.col("month") > F.col("reached"))
    sets = F.col("month").isNotNull()
    too_early = F.when(F.col("month") == F.col("reached"), "same_month").otherwise("backdated")
    rows = rows.withColumns(
        {
            "kept": sets & late_enough,
            "reason": F.coalesce("reason", F.when(sets & ~late_enough, too_early)),
        }
    )
    # Stored rows come first and are all ended by the first change that counts.
    counts = ~F.col("stored") & (F.col("is_del") | F.col("kept"))
    rows = rows.withColumn("event", F.when(counts, F.struct("is_del", "month", "seq", "changed_by", "changed_at")))
    # Segments ascend with the order; naming them lets this window use the sort of the one before.
    names, along = ", ".join(f"`{c}`" for c in unit), ", ".join(["segment", *order])
    rows = rows.withColumn("next", F.expr(f"lead(event, 1) ignore nulls over (partition by {names} order by {along})"))
    if was_split:
        rows = _carry_back(rows, keys)
    return ChangeSet(keys, payload, _outcome(rows, keys, payload))


def _refuse_delivered(rows: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """Mark the changes whose turn has passed. Only subjects that have one are looked up by row."""
    lowest = rows.groupBy(*keys).agg(F.min("seq").alias("lowest"))
    late = join_on(lowest, marks.select(*keys, "last_seq"), keys).where(F.col("lowest") <= F.col("last_seq"))
    late = broadcast_if_small(cut(late.select(*keys, "last_seq")))
    passed = F.when(F.col("seq") <= F.col("last_seq"), "already_delivered")
    return join_on(rows, late, keys, "left").withColumn("reason", F.coalesce("reason", passed)).drop("last_seq")


def _outcome(rows: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    deleted = F.coalesce(F.col("next.is_del"), F.lit(False))
    return rows.select(
        "id",
        *keys,
        *payload,
        "valid_from",
        F.when(~deleted, F.col("next.month")).alias("valid_to"),
        deleted.alias("is_deleted"),
        F.when(deleted, F.col("next.changed_at")).alias("deleted_at"),
        F.when(deleted, F.col("next.changed_by")).alias("deleted_by"),
        F.col("changed_by").alias("created_by"),
        F.col("changed_at").alias("created_at"),
        "seq",
        "stored",
        "kept",
        "reason",
        F.col("next.seq").alias("next_seq"),
        F.col("next.changed_by").alias("next_by"),
        F.col("next.changed_at").alias("next_at"),
    )


def _carry_in(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Continue the running month of each block with that of the blocks before it.

    Per block only three facts count: whether it has a delete, and the latest month
    after its last delete. They are summarised to one row per block, run over the
    blocks of a key, and joined back. Rows after a delete in their own block need
    nothing from before.
    """
    hot = rows.where(F.col("block") >= 0)
    per_segment = hot.groupBy(*keys, "block", "segment").agg(
        F.max("month").alias("latest"), F.max("is_del").alias("ends")
    )
    # A segment that ends in a delete leaves nothing behind; the open one, if any, does.
    summary = per_segment.groupBy(*keys, "block").agg(
        F.max("ends").alias("resets"), F.max(F.when(~F.col("ends"), F.col("latest"))).alias("tail")
    )
    along = Window.partitionBy(*keys).orderBy("block")
    summary = summary.withColumn("era", F.sum(F.col("resets").cast("int")).over(along))
    in_era = Window.partitionBy(*keys, "era").orderBy("block")
    summary = summary.withColumn("running", F.max("tail").over(in_era))
    carried = summary.select(*keys, "block", F.lag("running").over(along).alias("carried"))
    carried = broadcast_if_small(cut(carried))
    joined = join_on(rows, carried, [*keys, "block"], "left")
    first_segment = F.col("segment") == 0
    reached = F.when(first_segment, F.greatest("reached", "carried")).otherwise(F.col("reached"))
    return joined.withColumn("reached", reached).drop("carried")


def _carry_back(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Give the last rows of a block the first event of a later block."""
    hot = rows.where(F.col("block") >= 0)
    heads = hot.groupBy(*keys, "block").agg(
        F.min(F.when(F.col("event").isNotNull(), F.struct("seq", "id", "event"))).alias("head")
    )
    names = ", ".join(f"`{c}`" for c in keys)
    heads = heads.select(
        *keys,
        "block",
        F.expr(f"lead(head, 1) ignore nulls over (partition by {names} order by block)").alias("following"),
    )
    heads = broadcast_if_small(cut(heads))
    joined = join_on(rows, heads, [*keys, "block"], "left")
    return joined.withColumn("next", F.coalesce("next", F.col("following.event"))).drop("following")


@dataclass
class Flagged:
    """Rows changed by a soft delete or restore, before and after, and refused requests.

    ``scope`` is the condition that every changed row met before.
    """

    before: DataFrame
    after: DataFrame
    refused: DataFrame
    scope: Column

    def audit(self, changed_by: str | None = None, changed_at=None) -> DataFrame:
        """DELETE or RESTORE records. A delete carries its actor and time; a restore is given them."""
        gone = F.col("is_deleted")
        if changed_by is None and not self.after.where(~gone).isEmpty():
            raise ValueError("an audited restore needs an actor")
        flag = field_change("is_deleted", (~gone).cast("string"), gone.cast("string"))
        return audit_record(
            self.after.select(
                F.col("id").alias("forecast_entry_id"),
                "version_id",
                F.when(gone, "DELETE").otherwise("RESTORE").alias("action"),
                flag.alias("changed_fields"),
                F.when(gone, F.col("deleted_by")).otherwise(F.lit(changed_by)).alias("changed_by"),
                F.when(gone, F.col("deleted_at")).otherwise(F.lit(changed_at).cast("timestamp")).alias("changed_at"),
            )
        )

    def merge_into(self, entries: DataFrame) -> DataFrame:
        """The whole table after the change. Rows outside the scope pass through unjoined."""
        others = entries.where(~self.scope)
        kept = entries.where(self.scope).join(self.after.select("id"), "id", "left_anti").select(*entries.columns)
        return others.unionByName(kept).unionByName(self.after.select(*entries.columns))


def soft_delete(entries: DataFrame, requests: DataFrame, keys=SUBJECT) -> Flagged:
    """Flag the open row of each requested subject as deleted.

    ``requests`` has the keys, ``deleted_by`` and ``deleted_at``. Closed rows are not
    touched. A request without an open row, or without an actor, changes nothing and
    is returned as refused.
    """
    keys = list(keys)
    valid = requests.where(F.col("deleted_by").isNotNull() & F.col("deleted_at").isNotNull())
    asked = valid.groupBy(*keys).agg(F.min(F.struct("deleted_at", "deleted_by")).alias("ask"))
    live = entries.where(is_open())
    base = [c for c in entries.columns if c not in ("is_deleted", "deleted_at", "deleted_by")]
    hit = join_on(live, asked, keys)
    after = hit.select(
        *base,
        F.lit(True).alias("is_deleted"),
        F.col("ask.deleted_at").alias("deleted_at"),
        F.col("ask.deleted_by").alias("deleted_by"),
    )
    missing = join_on(asked, live.select(*keys), keys, "left_anti").select(*keys, F.lit("no_open_row").alias("reason"))
    anonymous = requests.where(F.col("deleted_by").isNull() | F.col("deleted_at").isNull()).select(
        *keys, F.lit("missing_actor").alias("reason")
    )
    return Flagged(hit.drop("ask"), after, missing.unionByName(anonymous), is_open())


def restore(entries: DataFrame, requests: DataFrame, keys=SUBJECT) -> Flagged:
    """Undo soft deletes, named by row ``id``.

    A row is refused if it is not deleted, or if its subject has an open row: two
    open rows would break the validity rules. Of several rows of one subject asked
    for at once, the latest is restored and the others are refused.
    """
    keys = list(keys)
    asked = requests.select("id").distinct()
    # As many rows as were asked for; kept, because every step below starts from them.
    deleted = cut(entries.where("is_deleted").join(asked, "id", "left_semi"))
    subjects = deleted.select(*keys).distinct()
    taken = cut(join_on(entries.where(is_open()), subjects, keys, "left_semi").select(*keys).distinct())
    free = join_on(deleted, taken, keys, "left_anti")
    latest = free.groupBy(*keys).agg(F.max(F.struct("valid_from", "created_at", "id")).alias("last")).select(F.col("last.id").alias("id"))
    before = free.join(latest, "id", "left_semi")
    base = [c for c in entries.columns if c not in ("is_deleted", "deleted_at", "deleted_by")]
    cleared = [
        F.lit(False).alias("is_deleted"),
        F.lit(None).cast("timestamp").alias("deleted_at"),
        F.lit(None).cast("string").alias("deleted_by"),
    ]
    not_deleted = asked.join(deleted, "id", "left_anti").select("id", F.lit("not_deleted").alias("reason"))
    occupied = join_on(deleted, taken, keys, "left_semi").select("id", F.lit("open_row_exists").alias("reason"))
    older = free.join(latest, "id", "left_anti").select("id", F.lit("later_row_restored").alias("reason"))
    refused = not_deleted.unionByName(occupied).unionByName(older)
    return Flagged(before.select(*entries.columns), before.select(*base, *cleared), refused, F.col("is_deleted"))


def scd2_close(change_set: ChangeSet) -> DataFrame:
    """Rows that the batch closed, stored ones and new ones."""
    return change_set.final.where(F.col("valid_to").isNotNull())
