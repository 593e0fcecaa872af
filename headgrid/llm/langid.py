"""Language identification by hierarchical discrimination.

Character n-grams of the whole text are hashed into a vector. Linear support vector machines
first tell language families apart, one for each family against the others. Within the family there is a
machine for each pair of languages, learned from those two alone; each gives one vote, and the sum
of its margins decides between languages with equal votes. The machines are learned from a bounded sample of
each language.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from headgrid.llm.common import bounded_sample, crc_fold, map_texts, sigmoid, stored

DIM = 2048
PER_LANGUAGE = 1000
UNKNOWN = "und"
#: Families of language codes. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk pl cs sk bg sr hr sl mk be bs",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "semitic": "ar he mt am",
    "indo-aryan": "hi bn mr gu pa ur ne si",
    "dravidian": "ta te kn ml",
    "austronesian": "id ms tl jv",
}


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes.split()), f"only {lang}")


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def features(text: str | None, dim: int = DIM) -> np.ndarray | None:
    """Hashed 1- to 3-grams of the letters, square roots of counts, length 1; None without a letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.concatenate([[32], np.where(letter, codes, 32), [32]]).astype(np.uint32)
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    at = b != 32  # n-grams around a letter
    a, b, c = a[at], b[at], c[at]
    shift = np.uint32(32 - int(dim).bit_length() + 1)
    first, second, third = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
    one = b * first
    two = (one ^ a * second) * third
    grams = ((one ^ np.uint32(0x51)) * second, two * first, (two ^ c * first) * second)
    counts = sum(np.bincount(g >> shift, minlength=dim) for g in grams)
    root = np.sqrt(counts).astype(np.float32)
    return root / np.sqrt(counts.sum(), dtype=np.float32)


def linear_svm(x: np.ndarray, positive: np.ndarray, weights: np.ndarray, penalty: float = 1e-3, steps: int = 150) -> np.ndarray:
    """Weights (with a bias last) that minimise the squared hinge loss, by accelerated gradient descent."""
    x = np.concatenate([x, np.ones((len(x), 1), dtype=x.dtype)], axis=1)
    y = np.where(positive, 1.0, -1.0).astype(np.float32)
    share = (weights / weights.sum()).astype(np.float32)
    w = v = np.zeros(x.shape[1], dtype=np.float32)
    rate = 1 / (4.0 + penalty)  # rows have length sqrt(2) at most, so the gradient's slope is at most 4
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        gradient = -2 * x.T @ (share * y * slack) + penalty * v
        following = v - np.float32(rate) * gradient
        v, w = following + np.float32(k / (k + 3)) * (following - w), following
    return w


@dataclass
class Model:
    """``families``: names with a machine each; ``languages``: of each family, names and a machine for each pair of them, in order."""

    families: list[str]
    family_w: np.ndarray
    languages: dict[str, tuple[list[str], np.ndarray]]
    dim: int

    def predict(self, text: str | None) -> tuple[str, float]:
        x = features(text, self.dim)
        if x is None or not self.families:
            return UNKNOWN, 0.0
        margins = self.family_w[:, :-1] @ x + self.family_w[:, -1]
        family = self.families[int(np.argmax(margins))]
        score = float(sigmoid(4 * margins.max())) if len(self.families) > 1 else 1.0
        names, w = self.languages[family]
        if len(names) > 1:
            best, margin = elect(len(names), w[:, :-1] @ x + w[:, -1])
            return names[best], score * float(sigmoid(4 * margin))
        return names[0], score


def elect(n: int, margins: np.ndarray) -> tuple[int, float]:
    """The language with most votes, and its smallest margin against another.

    ``margins`` are those of the pairs (0, 1), (0, 2), ... (n - 2, n - 1), positive for the first. Among equal votes
    the largest sum of margins decides, then the first language.
    """
    against = np.full((n, n), np.inf)
    first, second = np.triu_indices(n, 1)
    against[first, second], against[second, first] = margins, -margins
    votes = ((against > 0) & np.isfinite(against)).sum(axis=1)
    total = np.where(np.isfinite(against), against, 0).sum(axis=1)
    best = max(range(n), key=lambda i: (votes[i], total[i], -i))
    return best, float(against[best].min())


def _balanced(x: np.ndarray, own: np.ndarray) -> np.ndarray:
    """A machine for ``own`` against the other rows, both sides with equal weight."""
    return linear_svm(x, own, np.where(own, 0.5 / own.sum(), 0.5 / (~own).sum()))


def _one_against_one(x: np.ndarray, y: np.ndarray, names: list[str]) -> np.ndarray:
    """k (k - 1) / 2 machines, each from the rows of its two languages."""
    out = []
    for one, other in combinations(names, 2):
        pair = (y == one) | (y == other)
        out.append(_balanced(x[pair], y[pair] == one))
    return np.array(out, dtype=np.float32).reshape(len(out), x.shape[1] + 1)


def _one_against_rest(x: np.ndarray, y: np.ndarray, names: list[str]) -> np.ndarray:
    out = []
    for name in names:
        own = y == name
        if len(names) == 2 and out:
            out.append(-out[0])
        elif own.all():
            out.append(np.zeros(x.shape[1] + 1, dtype=np.float32))
        else:
            out.append(_balanced(x, own))
    return np.array(out, dtype=np.float32)


def fit_language_model(
    docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_language: int = PER_LANGUAGE, dim: int = DIM
) -> Model:
    """Learn from about ``per_language`` rows of each language (the only bound; twice that at most in all).

    Ids alone are drawn in one task and broadcast, at most twice ``common.MAX_SAMPLE``; texts stay where they are
    read. Of rows with the same id and language one is learned from.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
    drawn = stored(bounded_sample(known, "lang", "id", per_language)[0].distinct(), "sample")
    named = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sample = named.join(F.broadcast(drawn), ["id", "lang"], "left_semi")

    def work(texts):
        found = (features(t, dim) for t in texts)
        return [[None if x is None else x.tobytes() for x in found]]

    vectors = map_texts(sample, work, "x binary", ("id", "lang")).where("x is not null")
    rows = vectors.groupBy("id", "lang").agg(F.min("x").alias("x")).orderBy("lang", "id").collect()
    if not rows:
        return Model([], np.zeros((0, dim + 1), dtype=np.float32), {}, dim)
    x = np.stack([np.frombuffer(r["x"], dtype=np.float32) for r in rows])
    y = np.array([r["lang"] for r in rows], dtype=object)
    kin = np.array([family_of(lang) for lang in y], dtype=object)
    families = sorted(set(kin))
    languages = {}
    for family in families:
        own = kin == family
        names = sorted(set(y[own]))
        languages[family] = names, _one_against_one(x[own], y[own], names)
    return Model(families, _one_against_rest(x, kin, families), languages, dim)


def predict_language(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep``, lang_pred and score of every row. No other column is read.

    A null text, or one without a letter, is ``und`` with score 0, as is every text when
    nothing could be learned.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, lambda texts: list(zip(*map(sent.value.predict, texts))) or [[], []], "lang_pred string, score double", keep, text_col)


def language_id(
    docs: DataFrame,
    learn: Column | None = None,
    lang_col: str = "lang",
    id_col: str = "doc_id",
    text_col: str = "text",
    per_language: int = PER_LANGUAGE,
) -> DataFrame:
    """id, held_out, lang_pred and score of every row of ``docs``.

    Learns from rows for which ``learn`` holds and that have a language, text and id
    (default: crc32 of the id as text is not 1 modulo 3); ``held_out`` is False for a null id.

    * Repeated rows and ids keep one output row each; an empty table gives an empty result.
    * Texts are read whole, whatever their length. Ties between languages go to the first name.
    * Other columns are not read, so their names cannot clash.
    """
    fold = crc_fold(id_col, 3)
    model = fit_language_model(docs.where(fold != 1 if learn is None else learn), lang_col, id_col, text_col, per_language)
    found = predict_language(docs, model, (id_col,), text_col)
    return found.select(id_col, F.coalesce(crc_fold(id_col, 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
