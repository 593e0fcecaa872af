"""Insert-or-update of keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def upsert(table: DataFrame, batch: DataFrame, key: str, update: list[str], order: str) -> DataFrame:
    """``table`` after the batch: new keys are inserted whole, known keys get ``update``.

    Other columns of a known key keep their value, NULL included. Where the batch names a
    key several times, the result is that of one upsert after the other by ``order``: the
    last row gives the ``update`` columns, and the first row of a new key the others. Both are
    aggregates, so a key with very many rows is combined before the shuffle.
    """
    fields = [c for c in table.columns if c != key]
    row = F.struct(F.col(order).alias("__order"), *fields)
    ends = batch.groupBy(key).agg(F.min(row).alias("first"), F.max(row).alias("last"))
    stored = table.select(key, F.struct(*fields).alias("old"))
    both = stored.join(ends, key, "full_outer")
    known, changed = F.col("old").isNotNull(), F.col("last").isNotNull()
    columns = []
    for c in fields:
        old, new = F.col(f"old.{c}"), F.col(f"last.{c}" if c in update else f"first.{c}")
        value = F.when(changed & (~known | F.lit(c in update)), new).otherwise(old)
        columns.append(value.alias(c))
    return both.select(key, *columns)


def upsert_system_config(config: DataFrame, batch: DataFrame, at, order: str) -> DataFrame:
    """Settings after the batch. A known key keeps its description."""
    stamped = batch.withColumn("updated_at", F.lit(at))
    return upsert(config, stamped, "key", ["value", "updated_by", "updated_at"], order)
