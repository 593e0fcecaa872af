"""Splitting of hot keys into ordered blocks.

A window per key puts all rows of the key into one task. Where one key may hold a
large share of the rows, its rows are cut into consecutive ranges instead; the
window then runs per range, and a one-row summary per range carries the state over.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from headgrid.functions.keys import join_on
from headgrid.session import broadcast_if_small, cut

SPLIT_ROWS = 1_000_000
COLD = -1


def split_hot_keys(
    rows: DataFrame, keys: list[str], order: list[str], max_rows: int = SPLIT_ROWS, sizes: DataFrame | None = None
) -> tuple[DataFrame, bool]:
    """Add a column ``block``; returns the rows and whether any key was split.

    Keys with at most ``max_rows`` rows get the single block -1. The rows of larger
    keys are range-partitioned on ``(keys, order)`` into parts of about ``max_rows``
    rows, and the number of the part is the block: within a key, blocks follow the
    order. The split is kept in reliable storage, because range bounds are sampled
    and every use must see the same ones. There are at most ``rows / max_rows`` hot
    keys. Their sizes are counted on ``sizes`` where that is cheaper to read.
    """
    counted = rows if sizes is None else sizes
    hot = cut(counted.groupBy(*keys).count().where(F.col("count") > max_rows))
    stats = hot.agg(F.count("*").alias("n_keys"), F.sum("count").alias("n_rows")).first()
    if stats.n_keys == 0:
        return rows.withColumn("block", F.lit(COLD)), False
    hot = broadcast_if_small(hot.select(*keys))
    parts = math.ceil(stats.n_rows / max_rows) + 1
    split = (
        join_on(rows, hot, keys, "left_semi")
        .repartitionByRange(parts, *keys, *order)
        .withColumn("block", F.spark_partition_id())
    )
    cold = join_on(rows, hot, keys, "left_anti").withColumn("block", F.lit(COLD))
    return cold.unionByName(cut(split)), True
