"""Subject keys, deterministic ids and null-safe comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

SUBJECT = ("version_id", "employee_id", "container_id")


def subject_kind() -> Column:
    return F.when(F.col("employee_id").isNotNull(), "employee").otherwise("container")


def subject_key() -> Column:
    return F.coalesce(F.col("employee_id"), F.col("container_id"))


def hashed_id(*parts: str | Column) -> Column:
    """Id in UUID text form, equal for equal parts.

    ``uuid()`` would give other values when a task is run again after a lost
    executor; a hash of the row's identity does not. Each part is written with its length
    and NULL as a mark of its own, so that different parts never give the same text.
    """

    def text(part):
        value = (F.col(part) if isinstance(part, str) else part).cast("string")
        return F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    digest = F.md5(F.concat(*[text(p) for p in parts]))
    return F.concat_ws("-", *[F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def distinct_from(left: Column, right: Column) -> Column:
    return ~left.eqNullSafe(right)


def join_on(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join on equal keys where NULL equals NULL; the left key columns are kept.

    Spark plans the null-safe equality as an ordinary hash or merge join. The other
    columns of ``right`` must not occur in ``left``.
    """
    keys = list(keys)
    other = [c for c in right.columns if c not in keys]
    renamed = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *other)
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"__{k}" for k in keys])


def total(value: str | Column) -> Column:
    """Sum of a decimal measure at a fixed result type.

    The sum runs on the narrow type, which stays a long in the aggregation
    buffer; only the result is widened.
    """
    return F.sum(value).cast("decimal(38,4)")
