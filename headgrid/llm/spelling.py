"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

Runs of letters are counted in Arrow batches: the UTF-8 bytes of many texts are cut into runs by
array operations, equal runs are numbered once, and partial counts go to a combined aggregation.

Near words differ by one letter, so their letter counts differ by one in one letter or in two.
Words are blocked by length and, within a length, by how many letters they have of each of
``CLASSES`` classes; only blocks whose class counts can belong to near words meet, those of equal and
of adjacent lengths. For two blocks, NumPy gives all squared distances of letter counts from one
matrix product; pairs at the distance of one edit (2 in equal, 1 in adjacent lengths) are verified on
the letters. Large blocks are cut into chunks and every pair of chunks is one row of work, so no task
depends on the size of a block. Pairs are summed up for each word within a chunk and never leave it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from headgrid.llm.common import arrow_map, stored

LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A form has at least so many times the occurrences of the word.
RATIO = 5
#: One (document, run) of so many loses a letter.
DELETE_ONE_IN = 199
#: Letter classes that split the blocks of a length: the letter's code modulo this.
CLASSES = 5
#: Words of a chunk, and letters of a chunk, whatever is reached first.
CHUNK_WORDS = 1024
CHUNK_LETTERS = 1 << 22
#: Bytes of text that a task takes apart at once; a longer text is cut at a space or line break.
PIECE_BYTES = 8 << 20
#: Distances that one task computes, about.
TASK_PAIRS = 40_000_000

# a-z and U+00C0 to U+00FF (two bytes, the first is 0xC3).
LETTERS = [*range(0x61, 0x7B), *range(0xC0, 0x100)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
IS_ASCII_LETTER = np.zeros(256, bool)
IS_ASCII_LETTER[0x61:0x7B] = True


def _runs(data: np.ndarray, bounds: np.ndarray, least: int) -> tuple[pa.Array, np.ndarray]:
    """Runs of at least ``least`` letters in lower-cased UTF-8 ``data``, with the number of their text.

    ``bounds`` are the offsets of the texts; a run does not pass one.
    """
    first = data == 0xC3
    letter = IS_ASCII_LETTER[data] | first
    letter[1:] |= first[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = letter[1:] != letter[:-1]
    edge[bounds] = True
    cuts = np.flatnonzero(edge)
    begins, ends = cuts[:-1], cuts[1:]
    held = letter[begins]
    begins, ends = begins[held], ends[held]
    pairs = np.concatenate([[0], np.cumsum(first)])
    points = ends - begins - (pairs[ends] - pairs[begins])
    held = points >= least
    begins, ends = begins[held], ends[held]
    sizes = ends - begins
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    places = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - begins, sizes)
    made = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[places]))
    return made, np.searchsorted(bounds, begins, side="right") - 1


def _count(data: np.ndarray, bounds: np.ndarray, ids: Sequence, least: int, one_in: int | None) -> dict[str, int]:
    """Occurrences of each run in some texts, after letters were deleted."""
    runs, text = _runs(LOWER[data], bounds, least)
    coded = runs.dictionary_encode()
    words = coded.dictionary.to_pylist()
    if not words:
        return {}
    codes = coded.indices.to_numpy()
    keys, counts = np.unique(text.astype(np.int64) * len(words) + codes, return_counts=True)
    total = np.bincount(keys % len(words), weights=counts, minlength=len(words))
    found = dict(zip(words, total.astype(np.int64).tolist()))
    if one_in:
        encoded = [w.encode() for w in words]
        heads = [None if i is None else zlib.crc32(b"%d:" % i if isinstance(i, int) else f"{i}:".encode()) for i in ids]
        of_text, of_word = np.divmod(keys, len(words))
        for t, w, n in zip(of_text.tolist(), of_word.tolist(), counts.tolist()):
            if heads[t] is None:
                continue
            h = zlib.crc32(encoded[w], heads[t])
            if h % one_in == 0:
                word = words[w]
                at = h % len(word)
                shorter = word[:at] + word[at + 1 :]
                found[word] -= n
                found[shorter] = found.get(shorter, 0) + n
    return {w: n for w, n in found.items() if n and len(w) >= least}


def _pieces(offsets: np.ndarray, data: bytes):
    """(first text, last text, begin, end) of consecutive bytes, about PIECE_BYTES each."""
    at, n = 0, len(offsets) - 1
    while at < n:
        until = at + 1
        while until < n and offsets[until + 1] - offsets[at] <= PIECE_BYTES:
            until += 1
        begin, end = int(offsets[at]), int(offsets[until])
        while end - begin > PIECE_BYTES:  # one long text
            limit = begin + PIECE_BYTES
            cut = max(data.rfind(b" ", begin, limit), data.rfind(b"\n", begin, limit))
            if cut <= begin:
                later = [c for c in (data.find(b" ", limit, end), data.find(b"\n", limit, end)) if c >= 0]
                if not later:
                    break
                cut = min(later)
            yield at, until, begin, cut
            begin = cut
        yield at, until, begin, end
        at = until


def count_words(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    one_in: int | None = DELETE_ONE_IN,
) -> DataFrame:
    """(word, n): the words of all texts with at least ``least_length`` letters and ``least_count`` occurrences."""
    schema = _parse_datatype_string("word string, n long")
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).fill_null("").cast(pa.string())
            _, starts, buffer = texts.buffers()
            if buffer is None:
                continue
            offsets = np.frombuffer(starts, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            data = buffer.to_pybytes()
            for first, last, begin, end in _pieces(offsets, data):
                bounds = np.clip(offsets[first : last + 1], begin, end) - begin
                part = np.frombuffer(data, np.uint8, end - begin, begin)
                if len(part):
                    found = _count(part, bounds, ids[first:last], least_length, one_in)
                    yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], schema=arrow)

    parts = arrow_map(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), run, schema)
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _class_counts(word: Column) -> Column:
    def held(c):
        letters = "".join(chr(x) for x in LETTERS if x % CLASSES == c)
        return F.length(word) - F.length(F.translate(word, letters, ""))

    return F.array(*[held(c) for c in range(CLASSES)])


def _neighbours(counts: Column) -> Column:
    """Class counts that near words can have: the same, a letter of a later class turned into one of an
    earlier class, or a letter more. The other half meets them from the other side."""

    def moved(plus, minus=None):
        return F.array(*[F.get(counts, F.lit(i)) + int(i == plus) - int(i == minus) for i in range(CLASSES)])

    same = [moved(None)] + [moved(i, j) for i in range(CLASSES) for j in range(i + 1, CLASSES)]
    return F.array(*same, *[moved(i) for i in range(CLASSES)])


def _chunked(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks (key, parts) and their chunks (key, part, words), commonest words first."""
    keyed = words.select("word", "n", _class_counts(F.col("word")).alias("key"))
    length = F.aggregate("key", F.lit(0), lambda a, b: a + b)
    room = F.greatest(F.lit(1), F.least(F.lit(CHUNK_WORDS), F.floor(F.lit(CHUNK_LETTERS) / length)))
    blocks = keyed.groupBy("key").agg(F.count("*").alias("m"))
    blocks = stored(blocks.withColumn("parts", F.ceil(F.col("m") / room)), "spelling-blocks")
    part = F.pmod(F.xxhash64("word"), F.col("parts"))
    placed = keyed.join(blocks, "key").select("key", part.alias("part"), F.struct((-F.col("n")).alias("less"), "word").alias("w"))
    chunks = placed.groupBy("key", "part").agg(F.array_sort(F.collect_list("w")).alias("words"))
    return blocks, stored(chunks, "spelling-chunks")


class _Chunk:
    """Words of one length: their letters as a matrix of numbers, and their letter counts."""

    def __init__(self, words: list[str]):
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.int32)
        self.words = words
        self.letters = np.where(codes < 0xC0, codes - 0x61, codes - 0xC0 + 26).astype(np.uint8)
        m, length = self.letters.shape
        at = np.arange(m)[:, None] * len(LETTERS) + self.letters
        counts = np.bincount(at.ravel(), minlength=m * len(LETTERS)).reshape(m, len(LETTERS))
        # Products of counts stay exact below 2^24 in single precision.
        self.counts = counts.astype(np.float32 if length < 2_000 else np.float64)
        self.squares = (self.counts**2).sum(axis=1)


def near_pairs(a: _Chunk, b: _Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and ``b`` that differ by exactly one edit; ``b`` is as long or one letter longer."""
    longer = b.letters.shape[1] - a.letters.shape[1]
    distance = a.squares[:, None] + b.squares[None, :] - 2 * (a.counts @ b.counts.T)
    i, j = np.nonzero(distance == (1 if longer else 2))
    step, held = max(1, CHUNK_LETTERS // a.letters.shape[1]), []
    for at in range(0, len(i), step):
        x, y = a.letters[i[at : at + step]], b.letters[j[at : at + step]]
        if longer:
            # The letters before the added one and those after it are all that the shorter word has.
            ahead = np.logical_and.accumulate(x == y[:, :-1], axis=1).sum(axis=1)
            behind = np.logical_and.accumulate((x == y[:, 1:])[:, ::-1], axis=1).sum(axis=1)
            held.append(ahead + behind >= x.shape[1])
        else:
            held.append((x != y).sum(axis=1) == 1)
    keep = np.concatenate(held) if held else np.zeros(0, bool)
    return i[keep], j[keep]


def _summed(rows: np.ndarray, others: np.ndarray, own: _Chunk, other: list) -> list[tuple]:
    """(word, near words, less, form) of the rows that have one; ``other`` is sorted by preference."""
    if not len(rows):
        return []
    number = np.bincount(rows, minlength=len(own.words))
    best = np.full(len(own.words), len(other))
    np.minimum.at(best, rows, others)
    return [(own.words[r], int(number[r]), *other[best[r]]) for r in np.flatnonzero(number)]


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best) for words with a near word; best has ``less`` (minus its n) and ``word``."""
    blocks, chunks = _chunked(words)
    other = blocks.select(F.col("key").alias("other"), F.col("parts").alias("other_parts"), F.col("m").alias("other_m"))
    meet = blocks.withColumn("other", F.explode(_neighbours(F.col("key")))).join(other, "other")
    meet = stored(meet, "spelling-blocks-that-meet")
    work = meet.agg(F.sum(F.col("m") * F.col("other_m"))).first()[0] or 0
    pairs = meet.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    same = F.col("key") == F.col("other")
    start = F.when(same, F.col("part")).otherwise(F.lit(0).cast("long"))
    pairs = pairs.withColumn("other_part", F.explode(F.sequence(start, F.col("other_parts") - 1)))
    itself = same & (F.col("part") == F.col("other_part"))
    pairs = pairs.select("key", "part", "other", "other_part", itself.alias("itself"))
    theirs = chunks.toDF("other", "other_part", "theirs")
    joined = pairs.join(chunks, ["key", "part"]).join(theirs, ["other", "other_part"]).select("words", "theirs", "itself")
    # Few bytes mean much work here, so the number of tasks follows the distances to compute.
    joined = joined.repartition(max(1, math.ceil(work / TASK_PAIRS)) + 7)
    schema = _parse_datatype_string("word string, n_near long, less long, form string")
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            found = []
            for at in range(batch.num_rows):
                left, right = ([(w["less"], w["word"]) for w in batch.column(c)[at].as_py()] for c in (0, 1))
                a, b = _Chunk([w for _, w in left]), _Chunk([w for _, w in right])
                i, j = near_pairs(a, b)
                found += _summed(i, j, a, right)
                if not batch.column(2)[at].as_py():
                    found += _summed(j, i, b, left)
            columns = list(zip(*found)) if found else [[]] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    parts = arrow_map(joined, run, schema)
    best = F.min(F.struct("less", F.col("form").alias("word"))).alias("best")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)


def spelling_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    ratio: int = RATIO,
    one_in: int | None = DELETE_ONE_IN,
) -> DataFrame:
    """One row for each word of the corpus: word, form, root, n, n_near, form_n.

    Words are maximal runs of a-z and U+00C0 to U+00FF, A-Z lower-cased; of one (document, run) in
    ``one_in``, by the CRC-32 of `id:run`, all occurrences lose a letter (None: never).

    * A null text has no words; rows with a null id keep all letters; repeated rows count again.
    * Of near words with equal counts the smallest in code-point order is the form.
    * A word without a near word, or without one that is ``ratio`` times as common, is its own root.
    * An empty table gives an empty result; other columns have no effect. Texts and words may be of any length.
    """
    words = stored(count_words(docs, id_col, text_col, least_length, least_count, one_in), "spelling-words")
    near = near_words(words)
    form_n = -F.col("best.less")
    is_form = form_n >= F.col("n") * ratio
    found = words.join(near, "word", "left").select(
        "word",
        F.when(is_form, F.col("best.word")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, form_n).alias("form_n"),
    )
    found = stored(found, "spelling-forms")
    roots = _roots(found.where(F.col("form").isNotNull()).select("word", "form"), _longest_way(found, ratio, least_count))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def _longest_way(found: DataFrame, ratio: int, least_count: int) -> int:
    """Forms that can follow each other: each is ``ratio`` times as common as the one before."""
    if ratio < 2:
        raise ValueError("a form is at least twice as common")
    largest, steps = found.agg(F.max("n")).first()[0] or 0, 0
    while least_count * ratio ** (steps + 1) <= largest:
        steps += 1
    return steps


def _roots(links: DataFrame, longest: int) -> DataFrame:
    """(word, root): the last form from each word on, the way doubled in every round.

    A word is the form of as many words as it has near ones, so no join key is hot.
    """
    roots, steps = links.toDF("word", "root"), 1
    while steps < longest:
        ahead = roots.toDF("at", "further")
        joined = roots.join(ahead, F.col("root") == F.col("at"), "left")
        roots = stored(joined.select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
        steps *= 2
    return roots
