"""Mixing to target weights with soft membership in domains. DataFrame functions only.

A naive Bayes classifier on hashed words, learned from a table of labelled ids, gives each
document posteriors p_k of the domains. Rates r >= 0 of the documents, r = 1 at first, are fitted by
projected gradient descent on the weighted least squares

    sum over k of ((S_k - T_k) / N)^2 / a_k,    S_k = sum over documents of r * tokens * p_k,

where N counts all tokens, T_k = w_k * budget * N and a_k is the share of domain k in the input. In
the metric in which a document weighs as many as its tokens, a step is

    r <- max(0, r - sum over k of p_k * (S_k - T_k) / (N * a_k)),

whose curvature is at most 1, so steps of length 1 converge. A step needs the K sums S_k of all
documents and nothing else; a rate is thus a function of its document's posteriors and of the K
numbers of each step. A document is emitted floor(r + u) times, u a hash of its id in [0, 1).
"""

from __future__ import annotations

import json
import math
import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from headgrid.llm.common import fresh, labelled_sample, stored

BUCKETS = 4096
PER_DOMAIN = 3000
#: Words whose evidence counts in full: a longer text has the evidence of so many average words.
EVIDENCE = 60
#: Weight of the pooled frequency of a bucket, in words, against a domain's own count.
SMOOTHING = 200.0
STEPS = 60
TOLERANCE = 1e-4
#: Steps after which the rates so far are written, so that expressions stay short.
KEEP_EVERY = 12


@dataclass
class Mix:
    """Domains with their log-odds of each bucket and prior, and the steps of the fit."""

    domains: list[str]
    odds: list[list[float]]
    prior: list[float]
    steps: list[list[float]] = field(default_factory=list)
    totals: dict = field(default_factory=dict)

    def members(self) -> list[str]:
        return [f"p_{k}" for k in range(len(self.domains))]


def words_of(text: Column) -> Column:
    """Lower-cased words between ASCII white space."""
    plain = F.coalesce(text, F.lit(""))
    for space in "\t\n\v\f\r":
        plain = F.replace(plain, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(F.lower(plain), " "), "")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def fit_domains(docs: DataFrame, labelled: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", per_domain: int = PER_DOMAIN) -> Mix:
    """``labelled``: ids with a ``domain``. Learns from a bounded sample; at most BUCKETS * domains counts are collected."""
    sample, weights = labelled_sample(docs.select(id_col, text_col), labelled, "domain", id_col, per_domain, learn)
    words = sample.select("label_", F.explode(words_of(F.col(text_col))).alias("word"))
    counts = words.groupBy("label_", _bucket(F.col("word")).alias("bucket")).count().collect()
    domains = sorted(weights)
    own = {d: [0] * BUCKETS for d in domains}
    for r in counts:
        own[r["label_"]][r["bucket"]] = r["count"]
    size = {d: sum(own[d]) for d in domains}
    # pooled with equal weight for each domain that has words
    seen = [d for d in domains if size[d]]
    pooled = [sum(own[d][b] / size[d] for d in seen) / max(1, len(seen)) + 1e-9 for b in range(BUCKETS)]
    logs = {d: [math.log((own[d][b] + SMOOTHING * pooled[b]) / (size[d] + SMOOTHING) / pooled[b]) for b in range(BUCKETS)] for d in domains}
    rows = {r["label_"]: r["n"] for r in sample.groupBy("label_").agg(F.count("*").alias("n")).collect()}
    share = {d: weights[d] * rows.get(d, 0) + 1.0 for d in domains}
    return Mix(domains, [[round(x, 4) for x in logs[d]] for d in domains], [math.log(share[d] / sum(share.values())) for d in domains])


def _adder(table: Column):
    return lambda total, bucket: total + F.get(table, bucket)


def with_posteriors(docs: DataFrame, mix: Mix, text_col: str, tokens: str, members: list[str]) -> DataFrame:
    """``docs`` with the number of words and the posterior of each domain as new columns."""
    words, buckets, z = (fresh(docs, n) for n in ("words_", "buckets_", "logits_"))
    n = F.size(F.col(words))
    rows = docs.withColumn(words, words_of(F.col(text_col)))
    rows = rows.select("*", F.transform(words, _bucket).alias(buckets), n.cast("long").alias(tokens)).drop(words)
    scale = F.lit(float(EVIDENCE)) / F.greatest(F.lit(float(EVIDENCE)), F.col(tokens).cast("double"))
    logits = []
    for odds, prior in zip(mix.odds, mix.prior):
        total = F.aggregate(buckets, F.lit(0.0), _adder(F.from_json(F.lit(json.dumps(odds)), "array<double>")))
        logits.append(total * scale + F.lit(prior))
    rows = rows.select("*", F.array(*logits).alias(z)).drop(buckets)
    parts = F.transform(z, lambda v: F.exp(v - F.array_max(z)))
    rows = rows.withColumn(z, parts)
    total = F.aggregate(z, F.lit(0.0), lambda acc, v: acc + v)
    return rows.select("*", *[(F.get(z, F.lit(k)) / total).alias(m) for k, m in enumerate(members)]).drop(z)


def _step(rate: Column, move: list[float], members: list[str]) -> Column:
    change = F.lit(0.0)
    for m, g in zip(members, move):
        change = change + F.col(m) * F.lit(g)
    return F.greatest(F.lit(0.0), rate - change)


def rate_of(mix: Mix, members: list[str], steps: list[list[float]] | None = None, start: Column | None = None) -> Column:
    """The rate of a document as a function of its posteriors."""
    rate = F.lit(1.0) if start is None else start
    for move in mix.steps if steps is None else steps:
        rate = _step(rate, move, members)
    return rate


def fit_rates(rows: DataFrame, mix: Mix, targets: dict[str, float], budget: float = 1.0, steps: int = STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """Fit ``mix.steps``; ``rows`` have tokens and the columns of ``mix.members()``. Returns ``rows`` with rate.

    ``targets`` are weights of domains, scaled to sum 1 over the domains that were learned; others are 0.
    A fit that the step limit ends warns of what is left; ``mix.totals["error"]`` is the largest miss as a share of all words.
    """
    members = mix.members()
    sums = rows.agg(F.sum("tokens"), *[F.sum(F.col("tokens") * F.col(m)) for m in members]).first()
    n = float(sums[0] or 0)
    wanted = [max(0.0, targets.get(d, 0.0)) for d in mix.domains]
    now = [float(s or 0.0) for s in sums[1:]]
    mix.steps, mix.totals = [], {"tokens": n, "before": dict(zip(mix.domains, now))}
    if n == 0 or sum(wanted) == 0 or len(members) < 1:
        return rows.withColumn("rate", F.lit(1.0))
    goal = [w / sum(wanted) * budget * n for w in wanted]
    share = [max(s / n, 1e-6) for s in now]
    held, pending = rows.withColumn("rate", F.lit(1.0)), []
    for _ in range(steps):
        if max(abs(s - g) for s, g in zip(now, goal)) <= tolerance * n:
            break
        move = [(s - g) / (n * a) for s, g, a in zip(now, goal, share)]
        mix.steps.append(move)
        pending.append(move)
        rated = held.withColumn("rate", rate_of(mix, members, pending, F.col("rate")))
        if len(pending) == KEEP_EVERY:
            held, pending = stored(rated, "rates"), []
            rated = held
        now = [float(s or 0.0) for s in rated.agg(*[F.sum(F.col("rate") * F.col("tokens") * F.col(m)) for m in members]).first()]
    error = max(abs(s - g) for s, g in zip(now, goal)) / n
    mix.totals |= {"goal": dict(zip(mix.domains, goal)), "after": dict(zip(mix.domains, now)), "error": error}
    if error > tolerance:
        warnings.warn(f"mixing rates after {len(mix.steps)} steps miss a target by {error:.6f} of all words, tolerance {tolerance}", stacklevel=2)
    return held.withColumn("rate", rate_of(mix, members, pending, F.col("rate"))) if pending else held


def copies_of(rate: Column, id_col: Column) -> Column:
    """floor(rate + u) with u in [0, 1) from a hash of the id: rate copies on average, at least floor(rate)."""
    u = F.pmod(F.xxhash64(id_col.cast("string"), F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + u).cast("int")


def mixing_rates(
    docs: DataFrame,
    labelled: DataFrame,
    targets: dict[str, float],
    budget: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
    per_domain: int = PER_DOMAIN,
) -> tuple[DataFrame, Mix]:
    """id, ``keep``, tokens, p_<domain> of each learned domain, rate and copies of every row of ``docs``; and the fit.

    * Null and empty texts have no tokens and the prior as posteriors; they get a rate like others.
    * Null ids share one u. Repeated rows stay and get equal rates. Null labels are left out; of several
      labels of an id the largest counts.
    * Without a labelled document, or without tokens, nothing is fitted and all rates are 1.
    * An empty table gives an empty result. Other columns of ``docs`` are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)])
    mix = fit_domains(rows, labelled.select(F.col(id_col).alias("id"), "domain"), F.lit(True), "id", "text", per_domain)
    names = [f"keep_{i}" for i in range(len(keep))]
    narrow = with_posteriors(rows, mix, "text", "tokens", mix.members()).drop("text")
    rated = fit_rates(stored(narrow, "posteriors"), mix, targets, budget)
    out = rated.select("id", *names, "tokens", *mix.members(), "rate", copies_of(F.col("rate"), F.col("id")).alias("copies"))
    return out.toDF(id_col, *keep, "tokens", *[f"p_{d}" for d in mix.domains], "rate", "copies"), mix


def mix_documents(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float], budget: float = 1.0, id_col: str = "doc_id", text_col: str = "text", per_domain: int = PER_DOMAIN
) -> DataFrame:
    """The rows of ``docs``, each as often as its copies; all columns are kept. Shuffles no text."""
    _, mix = mixing_rates(docs, labelled, targets, budget, id_col, text_col, per_domain=per_domain)
    tokens, copy = fresh(docs, "tokens_"), fresh(docs, "copy_")
    members = [fresh(docs, f"{m}_") for m in mix.members()]
    rows = with_posteriors(docs, mix, text_col, tokens, members)
    times = F.sequence(F.lit(1), F.greatest(copies_of(rate_of(mix, members), F.col(id_col)), F.lit(0)))
    times = F.when(copies_of(rate_of(mix, members), F.col(id_col)) > 0, times).otherwise(F.array().cast("array<int>"))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(times).alias(copy)).drop(copy)


def label_domains(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, domain) of a table of quality and toxicity labels: toxic, poor or clean; rows without either label are left out."""
    domain = F.when(F.col("toxic") > 0, "toxic").when(F.col("quality") <= 0, "poor").when(F.col("quality") > 0, "clean")
    return labels.select(id_col, domain.alias("domain")).where("domain is not null")
