"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from headgrid.session import broadcast_if_small, shared_dir


#: Rows whose texts and results a worker holds as Python objects.
ROWS_AT_ONCE = 512


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def scratch(df: DataFrame, name: str) -> str:
    """A new folder below the one that all executors share."""
    return f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: what follows reads files that outlive any executor, and the
    planner knows their size.
    """
    path = scratch(df, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def positions(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with their place (from 0, column ``name``) in the ascending ``order``, nulls first.

    Rows are sorted in ranges and stored; a row's place is its number within its range plus the
    rows of the ranges before, of which there are as many as tasks. Rows equal in ``order`` have
    some order among themselves. Narrow rows are best: the sort reads its input twice.
    """
    at, run, ahead = (fresh(rows, n) for n in ("at_", "run_", "ahead_"))
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    ordered = stored(ordered, "ordered")
    # monotonically_increasing_id has the task in its upper 31 bits and the row in the lower 33.
    task, within = F.shiftright(at, 33), F.col(at).bitwiseAND((1 << 33) - 1)
    runs = ordered.groupBy(task.alias(run)).agg(F.count("*").alias("n"))
    earlier = Window.orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(run, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(ahead))
    return ordered.join(F.broadcast(runs), task == F.col(run)).withColumn(name, within + F.col(ahead)).drop(at, run, ahead)


def row_digest(columns: Sequence[str | Column]) -> Column:
    """SHA-256 (hex) over columns: `-` for null, else byte count, `:` and the value as text."""

    def field(column):
        value = (F.col(f"`{column}`") if isinstance(column, str) else column).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def arrow_map(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow``; workers that Spark starts on this machine find the package where the driver did."""
    context = df.sparkSession.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = context.environment.get("PYTHONPATH", "").split(os.pathsep)
    if context.master.startswith("local") and root not in paths:
        context.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return df.mapInArrow(run, schema)


def map_texts(
    docs: DataFrame, work: Callable[[list], Sequence], out: str, keep: Sequence[str] = ("doc_id",), text: str = "text"
) -> DataFrame:
    """``keep`` and the columns of the DDL ``out``, which ``work`` makes from a batch of texts.

    ``work`` gets a list of texts (None for null) and returns one list per column.
    Batches are bounded by Spark's Arrow limits (rows and bytes).
    """
    made = _parse_datatype_string(out)
    schema = StructType([docs.schema[k] for k in keep] + made.fields)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                columns = work(batch.column(len(keep)).to_pylist())
                arrays = [batch.column(i) for i in range(len(keep))]
                arrays += [pa.array(c, type=f.type) for c, f in zip(columns, list(arrow)[len(keep):])]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return arrow_map(docs.select(*keep, text), run, schema)


def filter_texts(docs: DataFrame, decide: Callable[[list], list[bool]], text: str = "text") -> DataFrame:
    """The rows of ``docs`` for which ``decide`` says True, with all their columns."""
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(decide(batch.column(at).to_pylist()), type=pa.bool_()))

    return arrow_map(docs, run, docs.schema)


def crc_fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(parts)


#: Most frequent classes that a sample is drawn of, and rows of all classes together.
MAX_CLASSES, MAX_SAMPLE = 256, 20_000


def bounded_sample(
    rows: DataFrame, class_col: str, id_col: str, per_class: int, max_classes: int = MAX_CLASSES, max_rows: int = MAX_SAMPLE
) -> tuple[DataFrame, dict]:
    """About ``per_class`` rows of each class, by a hash of the id, and {class: rows / expected rows of the sample}.

    Never more than twice that in all. Rows without a class or id are left out. Only the ``max_classes`` most frequent
    classes are learned, and with many of them fewer rows of each, so that about ``max_rows`` are drawn in all.
    """
    known = rows.where(F.col(class_col).isNotNull() & F.col(id_col).isNotNull())
    frequent = known.groupBy(class_col).count().orderBy(F.desc("count"), class_col).limit(max_classes)
    counts = {r[0]: r[1] for r in frequent.collect()}
    per_class = min(per_class, max(1, max_rows // max(1, len(counts))))
    rates = {c: min(1.0, per_class / n) for c, n in counts.items()}
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    rate = F.lit(0.0)
    for value, share in rates.items():
        rate = F.when(F.col(class_col) == F.lit(value), F.lit(share)).otherwise(rate)
    limit = max(1, 2 * per_class * len(counts))
    return known.where(draw < rate).orderBy(draw).limit(limit), {c: 1 / r for c, r in rates.items()}


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, per_class: int, learn: Column) -> tuple[DataFrame, dict]:
    """Documents with a label column ``label_``, a bounded sample of the labelled rows for which ``learn`` holds.

    Only ids and labels are sampled and broadcast, at most 2 * per_class * classes rows, so that
    no text is shuffled. Of several labels of an id the largest counts.
    """
    known = labels.where(learn & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("label_"))
    sample, weights = bounded_sample(known, "label_", id_col, per_class)
    return docs.join(F.broadcast(stored(sample, "sample")), id_col), weights


#: Labels (an id and a number each) that are sent to all tasks; more are joined by shuffle.
LABELS_AT_ONCE = 1_000_000


def labelled_rows(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, learn: Column) -> DataFrame:
    """All documents with a label for which ``learn`` holds, and the label as column ``label_``.

    Of several labels of an id the largest counts; null labels and ids are left out.
    """
    known = labels.where(learn & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = stored(known.groupBy(id_col).agg(F.max(label_col).alias("label_")), "labels")
    return docs.join(broadcast_if_small(known, LABELS_AT_ONCE), id_col)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
