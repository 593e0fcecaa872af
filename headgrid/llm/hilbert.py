"""Shards along a Hilbert curve, written as sorted files for pruning in several dimensions.

Each metadata dimension is quantised to ``bits`` bits at its exact quantiles over all rows, so that
skewed values fill the codes evenly. The curve index of the codes orders the rows, with the id and a
digest of the whole row behind it, and the order is cut into runs of nearly equal row counts. Rows
that are near in all dimensions are near in the files, whose column statistics are then narrow in
every dimension, not only in the first of a sort key.

Counts of values, row keys and their places are narrow; the only wide shuffle is the one that writes
the files. What the driver gets is bounded: 2^bits - 1 bounds a dimension and one key a shard. All of
it is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from headgrid.llm.common import fresh, positions, row_digest, scratch, stored

BITS = 6
DIMENSIONS = ("lang", "source", "n_chars")


def quantile_bounds(docs: DataFrame, column: str, bits: int = BITS) -> list[tuple]:
    """(code, smallest value with this code), ascending, at most 2^bits - 1 of them.

    Code c starts at the value that holds place c * rows / 2^bits of the sorted column, nulls first.
    Values are counted before they are sorted, so a value that most rows hold weighs one row.
    """
    counts = docs.groupBy(F.col(f"`{column}`").alias("value")).agg(F.count("*").alias("n"))
    placed = positions(counts, ["value"], "place")
    total = placed.agg(F.sum("n")).first()[0] or 0
    # The places cut the values into as many runs as make a window small.
    run = F.floor(F.col("place") / 65_536).alias("run")
    runs = placed.groupBy(run).agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.orderBy("run")) - F.col("n")
    within = F.sum("n").over(Window.partitionBy("run").orderBy("place"))
    reached = placed.withColumn("run", run).withColumn("upto", within).join(runs.select("run", before.alias("ahead")), "run")
    last = F.expr(f"((ahead + upto) * {1 << bits} + {max(total, 1)} - 1) div {max(total, 1)} - 1")
    first = F.expr(f"greatest(1, ((ahead + upto - n) * {1 << bits} + {max(total, 1)} - 1) div {max(total, 1)})")
    found = reached.where(F.col("value").isNotNull() & (last >= first)).select(last.alias("code"), "value")
    return [(int(r.code), r.value) for r in found.orderBy("code").collect()]


def quantised(column: str, bounds: list[tuple]) -> Column:
    """The code of a value: 0 for null and below the first bound."""
    if not bounds:
        return F.lit(0)
    value, (code, bound), *rest = F.col(f"`{column}`"), *reversed(bounds)
    out = F.when(value >= F.lit(bound), F.lit(code))
    for code, bound in rest:
        out = out.when(value >= F.lit(bound), F.lit(code))
    return out.otherwise(F.lit(0))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _bit(value: Column, b: Column) -> Column:
    return F.call_function("shiftright", value, b).bitwiseAND(1)


def hilbert_index(codes: Sequence[Column], bits: int = BITS) -> Column:
    """Place on the Hilbert curve of a point with ``bits``-bit coordinates.

    From the highest bit down, the lower bits of the axes are inverted or exchanged as the turn of
    each quadrant asks. The Gray code of the result, its bits interleaved, is the place.
    """
    n = len(codes)
    if n * bits > 62:
        raise ValueError("the index has at most 62 bits")

    def turn(x, step):
        low = step["q"] - 1
        first, own = F.get(x, F.lit(0)), F.get(x, step["axis"])
        swap = first.bitwiseXOR(own).bitwiseAND(low)
        inverted = F.transform(x, lambda v, k: F.when(k == 0, v.bitwiseXOR(low)).otherwise(v))
        swapped = F.transform(x, lambda v, k: F.when((k == 0) | (k == step["axis"]), v.bitwiseXOR(swap)).otherwise(v))
        return F.when(own.bitwiseAND(step["q"]) != 0, inverted).otherwise(swapped)

    def gray(x):
        axes = [F.get(x, F.lit(0))]
        for i in range(1, n):
            axes.append(axes[-1].bitwiseXOR(F.get(x, F.lit(i))))
        return F.array(*axes)

    def interleaved(x):
        order = [(b, axis) for b in range(bits - 1, -1, -1) for axis in range(n)]
        places = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(a).alias("axis")) for b, a in order])
        last, zero = F.get(x, F.lit(n - 1)), F.lit(0).cast("long")

        # Each set bit of the last axis inverts all lower bits of every axis. Bit `bits` is never set.
        def inversions(b):
            return F.aggregate(F.sequence(b + 1, F.lit(bits)), zero, lambda a, h: a.bitwiseXOR(_bit(last, h)))

        return F.aggregate(places, zero, lambda i, p: i * 2 + _bit(F.get(x, p["axis"]), p["b"]).bitwiseXOR(inversions(p["b"])))

    axes = F.array(*[c.cast("long") for c in codes])
    turns = [(1 << b, axis) for b in range(bits - 1, 0, -1) for axis in range(n)]
    if turns:
        steps = F.array(*[F.struct(F.lit(q).cast("long").alias("q"), F.lit(a).alias("axis")) for q, a in turns])
        axes = F.aggregate(steps, axes, turn)
    return _let(_let(axes, gray), interleaved)


@dataclass
class Shards:
    """Written shards: the folder, the columns of the rows, and the names of the added columns."""

    path: str
    docs: DataFrame
    columns: list[str]
    shard: str
    at: str


def write_shards(
    docs: DataFrame,
    path: str | None = None,
    n_shards: int = 24,
    dimensions: Sequence[str] = DIMENSIONS,
    id_col: str = "doc_id",
    bits: int = BITS,
) -> Shards:
    """Write ``docs`` as ``n_shards`` folders of Parquet files in curve order; counts differ by one at most.

    * A null in a dimension has the lowest code; null ids come first among equal indexes.
    * Rows with equal index and id follow the digest of all their columns. Rows equal throughout are
      interchangeable: those that a cut divides are counted and written again on both sides.
    * Fewer rows than shards leave some empty; an empty table leaves all of them.
    * Names of the added columns are lengthened until they don't clash.
    """
    path = path or scratch(docs, "shards")
    index, digest, shard, at = (fresh(docs, n) for n in ("curve", "digest", "shard", "at"))
    codes = [quantised(c, quantile_bounds(docs, c, bits)) for c in dimensions]
    rows = docs.withColumns({index: hilbert_index(codes, bits), digest: row_digest(docs.columns)})
    keys = rows.select(F.col(index).alias("curve"), F.col(f"`{id_col}`").alias("id"), F.col(digest).alias("digest"))
    placed = positions(stored(keys, "shard-keys"), ["curve", "id", "digest"], "place")
    n_rows = placed.count()
    # Where a shard begins; of several that begin at one place all but the last are empty.
    begins = {s * n_rows // n_shards: s for s in range(n_shards)}
    cuts = sorted(begins)[1:]
    key = ["curve", "id", "digest"]
    first = placed.where(F.col("place").isin(cuts)).select("place", *key) if cuts else placed.limit(0)
    same = reduce(lambda a, b: a & b, [F.col(f"p.{c}").eqNullSafe(F.col(f"f.{c}")) for c in key])
    # One row a cut is broadcast: at most n_shards - 1.
    spans = placed.alias("p").join(F.broadcast(first.alias("f")), same).groupBy(F.col("f.place").alias("cut")).agg(
        F.min("p.place").alias("begin"), *[F.first(f"p.{c}").alias(c) for c in key]
    )
    bounds = spans.orderBy("cut").collect()

    def ordered(i, ident, d):
        return F.struct(i, ident.isNotNull(), ident, d)

    id_type = docs.schema[id_col].dataType
    own = ordered(F.col(index), F.col(f"`{id_col}`"), F.col(digest))
    divided, number = [], F.lit(begins[0])
    for before, b in zip([0, *cuts], bounds):
        mark = ordered(F.lit(b.curve).cast("long"), F.lit(b.id).cast(id_type), F.lit(b.digest))
        # A cut within equal rows: what lies behind them is in the next shard.
        reached = own >= mark if b.begin == b.cut else own > mark
        number = number + F.when(reached, begins[b.cut] - begins[before]).otherwise(0)
        if b.begin < b.cut:
            divided.append(own == mark)
    numbered = rows.withColumn(shard, number.cast("int"))
    if divided:
        at_cut = reduce(lambda a, b: a | b, divided)
        again = _copies(rows.where(at_cut), [*docs.columns, index, digest], index, digest, bounds, begins, shard)
        numbered = numbered.where(~at_cut).unionByName(again)
    order = [shard, index, id_col, digest]
    done = numbered.repartitionByRange(*[F.col(f"`{c}`") for c in order]).sortWithinPartitions(*[F.col(f"`{c}`") for c in order])
    done.select(*[F.col(f"`{c}`") for c in docs.columns], shard, F.monotonically_increasing_id().alias(at)).write.partitionBy(
        shard
    ).parquet(path)
    return Shards(path, docs, list(docs.columns), shard, at)


def _copies(rows: DataFrame, columns, index: str, digest: str, bounds, begins: dict[int, int], shard: str) -> DataFrame:
    """Rows equal throughout that a cut divides: one of each with its count, then as many again."""
    one = F.first(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("row")
    kinds = rows.groupBy(F.col(index).alias("curve"), F.col(digest).alias("digest")).agg(one, F.count("*").alias("n"))
    begin = F.lit(None).cast("long")
    for b in bounds:
        begin = F.when((F.col("digest") == b.digest) & (F.col("curve") == b.curve), F.lit(b.begin)).otherwise(begin)
    each = kinds.select("row", F.explode(F.sequence(begin, begin + F.col("n") - 1)).alias("place"))
    number = F.lit(0)
    for place, s in sorted(begins.items()):
        number = F.when(F.col("place") >= place, F.lit(s)).otherwise(number)
    return each.select("row.*", number.cast("int").alias(shard))


def read_shards(shards: Shards, slot: str = "slot") -> DataFrame:
    """The rows of the files with their shard and their place in it, from 0 without gaps.

    A task wrote consecutive rows, so only rows per shard and task are counted, from one column.
    """
    spark, at, shard = shards.docs.sparkSession, shards.at, shards.shard
    schema = shards.docs.withColumns({at: F.lit(0).cast("long"), shard: F.lit(0)}).schema
    files = spark.read.schema(schema).parquet(shards.path)
    run, ahead = fresh(files, "run"), fresh(files, "ahead")
    task = F.shiftright(at, 33)
    runs = files.groupBy(F.col(shard).alias("s"), task.alias(run)).agg(F.count("*").alias("n"), F.min(at).alias("least"))
    earlier = Window.partitionBy("s").orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("s", run, (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("least")).alias(ahead))
    name = fresh(files, slot)
    # As many rows as tasks and shards.
    found = files.join(F.broadcast(runs.withColumnRenamed("s", "s_of_")), (F.col(shard) == F.col("s_of_")) & (task == F.col(run)))
    return found.withColumn(name, F.col(at) + F.col(ahead)).drop(at, run, ahead, "s_of_")


def shard_ranges(shards: Shards, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Least and largest value of each dimension and the rows of each shard: what a filter can leave out."""
    ends = [f(f"`{c}`").alias(f"{name}_{c}") for c in dimensions for f, name in ((F.min, "min"), (F.max, "max"))]
    return read_shards(shards).groupBy(F.col(shards.shard).alias("shard")).agg(F.count("*").alias("n_rows"), *ends)
