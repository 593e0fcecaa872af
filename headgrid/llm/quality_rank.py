"""Quality by Bradley-Terry pairwise ranking.

A document's score is linear in statistics of its text. The weights maximise the likelihood
that of every pair of a good and a poor document the good one wins, a logistic loss on the
difference of their features. The cut is the rank that agrees best with the labels. All labelled
rows of the learned fold take part, in all pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from headgrid.llm.common import arrow_map, crc_fold, labelled_rows, map_texts, positions, sigmoid, stored
from headgrid.session import broadcast_if_small

N_STATS = 14
STAT_NAMES = [f"s{i}" for i in range(N_STATS)]
#: Steps of each statistic, cut at quantiles of the labelled rows: lets a linear score follow thresholds.
STEPS = 8
#: Steps of rank to which the chances of pairs are rounded.
GRID = 512
#: Tasks that sum up arrays for the driver.
SUM_TASKS = 64
SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()\-]")


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text; all are defined for empty texts."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n, chars = max(len(words), 1), max(len(text), 1)
    counts = Counter(words)
    following = set(zip(words, words[1:]))
    digits = sum(text.count(d) for d in "0123456789")
    return [
        np.log1p(len(words)),
        len(raw) / n,
        len(SYMBOL.findall(text)) / chars,
        digits / chars,
        sum(1 for _ in re.finditer(r"[A-Z]", text)) / chars,
        sum(text.count(p) for p in ".,;:!?") / n,
        len(counts) / n ** 0.85,
        max(counts.values(), default=0) / n,
        sum(c for w, c in counts.items() if len(w) <= 1) / n,
        len(following) / max(len(words) - 1, 1),
        sum(a == b for a, b in zip(words, words[1:])) / n,
        len(set(lines)) / max(len(lines), 1),
        np.log1p(len(raw) / max(len(lines), 1)),
        len(zlib.compress(raw, 1)) / (len(raw) + 40),
    ]


@dataclass
class Model:
    edges: np.ndarray  # (statistics, steps)
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float = 0.0
    spread: float = 1.0

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -4, 4)
        steps = stats[:, :, None] > self.edges[None]
        return np.concatenate([z, steps.reshape(len(stats), -1)], axis=1)

    def rank(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def scores(self, stats: np.ndarray) -> np.ndarray:
        return sigmoid((self.rank(stats) - self.cut) / self.spread)


def matrix(batch: pa.RecordBatch, at: int = 0) -> np.ndarray:
    return np.stack([batch.column(at + i).to_numpy(zero_copy_only=False) for i in range(N_STATS)], axis=1)


def collected(rows: DataFrame, work: Callable[[Iterable[tuple]], list[np.ndarray]]) -> list[np.ndarray]:
    """Sums over all tasks of the arrays that ``work`` makes of a task's batches (statistics, good).

    At most SUM_TASKS arrays of a fixed size come to the driver. They are added in the order of the tasks.
    """

    def run(batches):
        arrays = work((matrix(b), b.column(N_STATS).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows)
        flat = np.concatenate([np.ravel(x) for x in arrays]).astype("<f8")
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([flat.tobytes()], pa.binary())], names=["task", "sums"])

    parts = sorted(arrow_map(rows.select(*STAT_NAMES, "good").coalesce(SUM_TASKS), run, "task long, sums binary").collect())
    shapes = work(iter(()))
    total = np.sum([np.frombuffer(p["sums"], "<f8") for p in parts], axis=0) if parts else np.concatenate([np.ravel(x) for x in shapes])
    ends = np.cumsum([x.size for x in shapes])
    return [part.reshape(x.shape) for part, x in zip(np.split(total, ends[:-1]), shapes)]


def exact_quantiles(rows: DataFrame, n: int) -> np.ndarray:
    """The STEPS inner quantiles of each statistic over all ``n`` rows, interpolated as numpy does; (statistics, steps)."""
    at = np.linspace(0, 1, STEPS + 2)[1:-1] * (n - 1)
    low = np.floor(at).astype(int)
    high = np.minimum(low + 1, n - 1)
    wanted = sorted({int(k * n + i) for k in range(N_STATS) for i in (*low, *high)})
    values = rows.select(F.posexplode(F.array(*STAT_NAMES)).alias("stat", "value"))
    # Many rows may share a value; the number of the row spreads them over ranges.
    placed = positions(values.withColumn("row", F.monotonically_increasing_id()), ["stat", "value", "row"], "place")
    found = {r["place"]: r["value"] for r in placed.where(F.col("place").isin(wanted)).collect()}
    lows, highs = (np.array([[found[k * n + i] for i in ends] for k in range(N_STATS)]) for ends in (low, high))
    return lows + (at - low) * (highs - lows)


def bradley_terry(rows: DataFrame, model: Model, penalty: float = 1e-2, steps: int = 25) -> np.ndarray:
    """Weights that maximise the penalised likelihood of every good row beating every poor one (Newton).

    The mean runs over all pairs, which are never formed: the chance that a row loses depends on the other only by its
    rank. So a pass counts ranks and sums features by GRID steps of rank, and each row meets the sums of the other
    class. Only the chances are rounded to the grid; features are not.
    """
    width = N_STATS * (STEPS + 1)
    w = np.zeros(width)
    for _ in range(steps):
        # A statistic is at most 4 deviations off, so that this bounds all ranks.
        reach = 4 * np.abs(w[:N_STATS]).sum() + np.abs(w[N_STATS:]).sum() + 1e-9
        middles = (np.arange(GRID) + 0.5) / GRID * 2 * reach - reach

        def cells(x, w=w, reach=reach):
            return np.clip(((x @ w + reach) / (2 * reach) * GRID).astype(int), 0, GRID - 1)

        def sums(batches):
            counts, features = np.zeros((2, GRID)), np.zeros((2, GRID, width))
            for stats, good in batches:
                x = model.features(stats)
                cell = cells(x)
                for side in (0, 1):
                    own = good == bool(side)
                    counts[side] += np.bincount(cell[own], minlength=GRID)
                    order = np.argsort(cell[own], kind="stable")
                    found, first = np.unique(cell[own][order], return_index=True)
                    if len(found):
                        features[side][found] += np.add.reduceat(x[own][order], first, axis=0)
            return [counts, features]

        (poor, good), (poor_x, good_x) = collected(rows, sums)
        upset = sigmoid(middles[None, :] - middles[:, None])  # (good cell, poor cell)
        pairs = poor.sum() * good.sum()
        weight = upset * (1 - upset)
        gradient = ((upset @ poor) @ good_x - (upset.T @ good) @ poor_x) / pairs - penalty * w
        curve = np.stack([weight.T @ good, weight @ poor]) / pairs  # of a poor, of a good row

        def squares(batches):
            out = np.zeros((width, width))
            for stats, good in batches:
                x = model.features(stats)
                out += (x * curve[good.astype(int), cells(x)][:, None]).T @ x
            return [out]

        cross = good_x.T @ weight @ poor_x / pairs
        hessian = collected(rows, squares)[0] - cross - cross.T + penalty * np.eye(width)
        step = np.linalg.solve(hessian, gradient)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def best_cut(ranked: DataFrame) -> float:
    """The cut between the ranks of all rows with the fewest errors, in the widest such gap.

    Ranks are sorted in ranges; what goes before a range is known from one row for each range.
    """
    steps = ranked.groupBy("rank").agg(F.sum(F.when(F.col("good"), 1).otherwise(-1)).alias("step"))
    steps = stored(steps.repartitionByRange("rank").withColumn("run", F.spark_partition_id()), "ranks")
    runs = steps.groupBy("run").agg(F.sum("step").alias("steps"), F.min("rank").alias("first"))
    in_order = Window.orderBy("run")
    runs = runs.select(
        "run",
        F.coalesce(F.sum("steps").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"),
        F.lead("first").over(in_order).alias("next"),
    )
    within = Window.partitionBy("run").orderBy("rank")
    # Rejecting all up to a rank loses its good rows; its poor ones were errors before.
    low, high = F.col("rank"), F.coalesce(F.lead("rank").over(within), F.col("next"), F.col("rank") + 1)
    cuts = steps.join(broadcast_if_small(runs), "run").select(
        (F.col("ahead") + F.sum("step").over(within)).alias("wrong"), low.alias("low"), high.alias("high")
    )
    least = steps.agg(F.min("rank")).select(F.lit(0).alias("wrong"), (F.col("min(rank)") - 1).alias("low"), F.col("min(rank)").alias("high"))
    best = cuts.unionByName(least).orderBy("wrong", F.desc(F.col("high") - F.col("low")), "low").first()
    return (best["low"] + best["high"]) / 2


def fit_quality(rows: DataFrame) -> Model | None:
    """Learn from all ``rows``, statistics of texts with a boolean ``good``; None without both classes."""

    def moments(batches):
        out = [np.zeros(()), np.zeros(()), np.zeros(N_STATS)]
        for stats, good in batches:
            out = [out[0] + len(good), out[1] + good.sum(), out[2] + stats.sum(axis=0)]
        return out

    n, n_good, total = collected(rows, moments)
    if not 0 < n_good < n:
        return None
    mean = total / n

    def deviations(batches):
        return [sum((((stats - mean) ** 2).sum(axis=0) for stats, _ in batches), np.zeros(N_STATS))]

    scale = np.sqrt(collected(rows, deviations)[0] / n)
    model = Model(exact_quantiles(rows, int(n)), mean, np.maximum(scale, 1e-6), np.empty(0))
    model.weights = bradley_terry(rows, model)

    def spread(batches):
        out = np.zeros(2)
        for stats, _ in batches:
            rank = model.rank(stats)
            out = out + [rank.sum(), (rank**2).sum()]
        return [out]

    first, second = collected(rows, spread)[0] / n
    model.cut = best_cut(with_stats(rows, lambda stats: model.rank(stats), "rank", ("good",)))
    model.spread = max(float(np.sqrt(max(second - first**2, 0.0))) / 4, 1e-6)
    return model


def with_stats(rows: DataFrame, work: Callable[[np.ndarray], np.ndarray], name: str, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` and a double column that ``work`` makes of the statistics of a batch."""
    schema = StructType([rows.schema[k] for k in keep] + [StructField(name, DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(work(matrix(b, len(keep))), pa.float64())], schema=arrow)

    return arrow_map(rows.select(*keep, *STAT_NAMES), run, schema)


def quality_rank(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """id, held_out, score and predicted of every row of ``docs``.

    Labels are learned from ids whose crc32 as text is not 1 modulo 3; the others, and no null
    id, are ``held_out``. Only the text enters a score.

    * Null and empty texts are ranked by the statistics of an empty text.
    * Repeated rows keep one output row each. Of several labels of an id the largest counts; null
      labels and labels without a document are left out.
    * Without labels of both classes nothing is learned and all scores are 0.5.
    * An empty table gives an empty result. Texts are read whole and once, for their statistics, which are
      stored; learning and scores read these. Other columns are not read.
    """
    types = ", ".join(f"{name} double" for name in STAT_NAMES)
    found = map_texts(docs.select(F.col(id_col).alias("id_"), text_col), lambda t: list(zip(*map(statistics, t))), types, ("id_",), text_col)
    found = stored(found, "statistics")
    known = labels.select(F.col(id_col).alias("id_"), F.col(label_col).alias("quality_"))
    rows = labelled_rows(found, known, "quality_", "id_", crc_fold("id_", 3) != 1)
    model = fit_quality(stored(rows.select(*STAT_NAMES, (F.col("label_") > 0).alias("good")), "labelled"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(stats):
        return np.full(len(stats), 0.5) if sent.value is None else sent.value.scores(stats)

    held_out = F.coalesce(crc_fold("id_", 3) == 1, F.lit(False)).alias("held_out")
    scored = with_stats(found, work, "score", ("id_",))
    return scored.select(F.col("id_").alias(id_col), held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
