"""Table rules as violation listings. Empty results mean that the rules hold."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from headgrid.functions.keys import join_on, subject_key, subject_kind
from headgrid.operators.blocks import SPLIT_ROWS, split_hot_keys
from headgrid.session import broadcast_if_small, cut

OPEN_END = "9999-12-31"
#: More than twice the days from year 1 to 9999, so that two days fit into one number.
SPAN = 1 << 24
#: Rows of a task that looks for repeated keys.
KEY_ROWS = 500_000


def _key_text(columns: list[str]) -> Column:
    return F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns])


def dq_unique(table: DataFrame, rule: str, key: list[str], sizes: DataFrame | None = None) -> DataFrame:
    """Keys held by more than one row, with how many.

    Nearly all keys differ, so that counts combined before the shuffle would hold as many keys as a task reads. Only
    the keys are shuffled, uncombined, to as many tasks as give each about KEY_ROWS rows: what a task holds doesn't
    grow with the table. A key of very many rows is one count. The rows are counted on ``sizes``, a table of at least
    as many rows, where that is cheaper to read.
    """
    n_rows = (table if sizes is None else sizes).count()
    keys = table.select(*key).repartition(max(1, math.ceil(n_rows / KEY_ROWS)), *key)
    counted = keys.groupBy(*key).agg(F.count("*").alias("n_rows")).where("n_rows > 1")
    return counted.select(F.lit(rule).alias("rule"), _key_text(key).alias("key"), "n_rows")


def dq_one_working(versions: DataFrame) -> DataFrame:
    """Working versions, if there is more than one."""
    n = versions.where(F.col("status") == "working").agg(F.count("*").alias("n_rows")).where("n_rows > 1")
    return n.select(F.lit("one_working_version").alias("rule"), F.lit("working").alias("key"), "n_rows")


def dq_checks(table: DataFrame, rules: dict[str, str], key: str = "id") -> DataFrame:
    """Rows that break a rule, one output row per broken rule.

    Rules are SQL conditions that must not be false; NULL passes, as in a CHECK
    constraint. All rules of a table are tested in one scan.
    """
    broken = F.array(*[F.when(~F.expr(condition), F.lit(name)) for name, condition in rules.items()])
    return table.select(
        F.explode(F.filter(broken, lambda name: name.isNotNull())).alias("rule"),
        F.col(key).cast("string").alias("key"),
    )


def dq_foreign_keys(child: DataFrame, column: str, parent: DataFrame, parent_key: str, rule: str) -> DataFrame:
    """Values of ``column`` without a parent row, with how many rows hold them.

    The values are counted before the join, so a value that a third of the table
    holds is one row by then.
    """
    values = child.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n_rows"))
    known = parent.select(F.col(parent_key).alias("value"))
    return values.join(known, "value", "left_anti").select(
        F.lit(rule).alias("rule"), F.col("value").cast("string").alias("key"), "n_rows"
    )


def dq_overlap(entries: DataFrame, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Live rows whose interval overlaps one that starts earlier or on the same day.

    One output row per subject and start: how many rows start there, and the start and
    end of the row that reaches furthest over it. Rows are shuffled once, by subject, and
    reduced to one per start; a running maximum over the starts then says how far the earlier
    rows reach. End and start are kept in one number, so the maximum is one of longs. Subjects
    with more than ``split_rows`` rows are worked on in blocks of consecutive starts, and the
    maximum of the blocks before is carried into each. No pairs are formed.
    """
    subject = ["version_id", "subject_kind", "subject_key"]
    epoch = F.lit("1970-01-01").cast("date")
    rows = entries.where(~F.col("is_deleted")).select(
        "version_id",
        subject_kind().alias("subject_kind"),
        subject_key().alias("subject_key"),
        F.date_diff("valid_from", epoch).alias("start"),
        F.date_diff(F.coalesce(F.col("valid_to"), F.lit(OPEN_END).cast("date")), epoch).alias("until"),
    )
    rows, was_split = split_hot_keys(rows, subject, ["start"], split_rows)
    # The block is a constant where no subject was split, and no part of a partitioning then.
    unit = [*subject, "block"] if was_split else subject
    starts = rows.repartition(*unit).groupBy(*unit, "start").agg(F.count("*").alias("n_rows"), F.max("until").alias("until"))
    # The later end wins, and the later start among equal ends.
    starts = starts.withColumn("reach", F.col("until").cast("long") * SPAN + F.col("start"))
    earlier = Window.partitionBy(*unit).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    found = starts.withColumn("over", F.max("reach").over(earlier))
    if was_split:
        blocks = starts.where("block >= 0").groupBy(*unit).agg(F.max("reach").alias("reach"))
        before = Window.partitionBy(*subject).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        carried = blocks.select(*unit, F.max("reach").over(before).alias("carried"))
        found = join_on(found, broadcast_if_small(cut(carried)), unit, "left").withColumn("over", F.greatest("over", "carried"))
    # Starts before 1970 are negative, and so is the lower part of the number then.
    over_until = F.floor((F.col("over") + SPAN // 2) / SPAN)
    over_from = F.col("over") - over_until * SPAN
    reached = over_until > F.col("start")
    until = F.when(reached, over_until).otherwise(F.col("until"))
    open_end = F.date_diff(F.lit(OPEN_END).cast("date"), epoch)

    def day(number):
        return F.date_add(epoch, number.cast("int"))

    return found.where(reached | (F.col("n_rows") > 1)).select(
        *subject,
        day(F.col("start")).alias("valid_from"),
        "n_rows",
        day(F.when(reached, over_from).otherwise(F.col("start"))).alias("overlaps_from"),
        F.when(until != open_end, day(until)).alias("overlaps_to"),
    )


def _part_digests(rows: DataFrame, part: str, columns: list[str], side: str) -> DataFrame:
    """Count and order-free digest of the rows of each part.

    Sums of 30-bit pieces of two hashes: unlike an exclusive or, a sum sees rows that
    come twice. A sum of longs holds 2^33 rows of a part, and overflows with an error.
    """
    # Hashes skip NULLs, so each column goes with a flag.
    values = [F.col(c) for c in columns] + [F.col(c).isNull() for c in columns]
    rows = rows.select(F.col(part).alias("part"), F.xxhash64(*values).alias("one"), F.xxhash64(F.lit("two"), *reversed(values)).alias("two"))
    pieces = [F.sum(F.shiftrightunsigned(h, at).bitwiseAND((1 << 30) - 1)) for h in ("one", "two") for at in (0, 30)]
    return rows.groupBy("part").agg(F.struct(F.count("*"), *pieces).alias(side))


def dq_immutable(before: DataFrame, after: DataFrame, columns: list[str], part: str | None = None) -> DataFrame:
    """Rows of ``before`` that ``after`` no longer has unchanged; additions are allowed.

    With ``part`` (the run of actuals, the version of an audit record), rows are summed up in a count
    and a digest for each part first, combined before the shuffle, and only the rows of parts that
    differ are compared: a state without changes costs a scan of each side. A part with additions
    is compared too. Maps are compared as JSON text, since Spark has no set difference on maps.
    """
    kinds = dict(before.dtypes)
    values = [F.to_json(c).alias(c) if kinds[c].startswith("map<") else F.col(c) for c in columns]
    old, new = before.select(*values), after.select(*values)
    if part is not None:
        sums = join_on(_part_digests(old, part, columns, "old"), _part_digests(new, part, columns, "new"), ["part"], "left")
        changed = cut(sums.where(~F.col("old").eqNullSafe(F.col("new"))).select(F.col("part").alias(part)))
        if changed.isEmpty():
            return old.limit(0)
        changed = broadcast_if_small(changed)
        old, new = (join_on(df, changed, [part], "left_semi") for df in (old, new))
    return old.exceptAll(new)


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
