"""Encoding of texts by way of remembered words.

The byte-level patterns used here let a pre-token begin with one space, and otherwise never
mix white space with other characters. So where words are separated by single spaces or line
feeds, a pre-token never reaches across the start of a space or a line feed, and each word with
the space before it can be cut on its own. Words repeat; a worker remembers their ids. Texts
with other white space at their ends or in a row are cut as a whole.

Arrow numbers the different words of a group of texts, so that Python looks up each of them once
a group; the ids of the texts are then gathered by number. New words are cut and merged together,
a line feed between them. A full memory forgets the words met in the fewest groups.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import regex

#: Words that a worker remembers (of texts cut as a whole, pre-tokens), and the longest one that it does.
MEMO = 150_000
LONGEST = 64
#: Texts worked on at a time, and characters after which a group ends; one text is never cut.
GROUP = 2048
GROUP_CHARS = 1 << 23
#: Words whose ids are gathered at a time.
GATHER = 1 << 18
EDGES = ("  ", " \n", "\n ", "\n\n")


def unicode_pattern(pattern: str) -> regex.Pattern:
    """The pattern with white space as Unicode's property has it, which the module's ``\\s`` is not quite."""
    return regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))


def even(text: str) -> bool:
    """Whether the only white space is single spaces and line feeds between other printable characters."""
    return (
        text.replace("\n", "").isprintable()
        and not any(e in text for e in EDGES)
        and text[0] not in " \n"
        and text[-1] not in " \n"
    )


class Memo:
    """Ids of words, in one array. A word's number is its place among them."""

    def __init__(self, most: int):
        self.most, self.known, self.ids = most, {}, np.zeros(0, dtype="<u4")
        # where a word's ids start, how many they are, and the groups that it was met in
        self.start, self.size, self.met = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def numbers(self, words: list[str]) -> np.ndarray:
        """Number of each word; -1 if it is not remembered."""
        return np.fromiter(map(self.known.get, words, repeat(-1)), dtype=np.int64, count=len(words))

    def add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Remember different new words; ``ids`` are theirs one after the other, ``sizes`` how many each has."""
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.met = np.concatenate([self.met, np.zeros_like(sizes)])
        self.ids = np.concatenate([self.ids, ids])

    def forget_after(self, n: int) -> None:
        """Remember the first ``n`` words only."""
        if n < len(self.known):
            self.ids = self.ids[: self.start[n]]
            self.start, self.size, self.met = self.start[:n], self.size[:n], self.met[:n]
            while len(self.known) > n:
                self.known.popitem()

    def make_room(self) -> None:
        """Of too many words, keep those met in the most groups, at most half as many as fit. Groups long ago count less."""
        if len(self.known) > self.most:
            nth = len(self.met) - 1 - self.most // 2
            kept = self.met > np.partition(self.met, nth)[nth]
            words, start, size = list(compress(self.known, kept.tolist())), self.start[kept], self.size[kept]
            self.known = dict(zip(words, range(len(words))))
            self.ids = runs(self.ids, start, size)
            self.start, self.size, self.met = np.cumsum(size) - size, size, self.met[kept] // 2


class ChunkEncoder:
    """``merge`` gets pre-tokens, repeated ones too; it returns their ids one after the other and how many each has.

    ``whole``, if given, encodes texts that can't be cut into words, or that ``special`` picks.
    """

    def __init__(
        self,
        pattern: str,
        merge: Callable[[list[str]], tuple[np.ndarray, np.ndarray]],
        whole: Callable[[list[str]], Sequence[bytes]] | None = None,
        special: Callable[[str], bool] = lambda text: False,
        memo: int = MEMO,
    ):
        self.pattern, self.merge, self.whole, self.special = unicode_pattern(pattern), merge, whole, special
        self.memo = Memo(memo)

    def _learn_words(self, words: list[str]) -> None:
        """Remember new words of even texts, none of them a line feed."""
        if words:
            parts = self.pattern.findall("\n".join(words))
            breaks = np.fromiter(map("\n".__eq__, parts), dtype=bool, count=len(parts))
            last = np.append(np.flatnonzero(breaks), len(parts)) - np.arange(len(words))
            ids, sizes = self.merge(list(compress(parts, (~breaks).tolist())))
            self.memo.add(words, ids, np.diff(np.cumsum(sizes)[last - 1], prepend=0))

    def _learn_tokens(self, tokens: list[str]) -> None:
        """Remember new pre-tokens."""
        if tokens:
            self.memo.add(tokens, *self.merge(tokens))

    def _group(self, texts: Sequence[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        plain, rest = [], []
        for at, text in enumerate(texts):
            if text:
                (plain if even(text) and not self.special(text) else rest).append(at)
        words, numbers, ends = numbered_words([texts[at] for at in plain])
        tokens = {"\n"}
        if rest and self.whole:
            for at, found in zip(rest, self.whole([texts[at] for at in rest])):
                out[at] = found
        elif rest:
            parts = [self.pattern.findall(texts[at]) for at in rest]
            tokens.update(*parts)
            place = {w: i for i, w in enumerate(words)}
            more = np.array([place.setdefault(t, len(place)) for p in parts for t in p], dtype=np.int64)
            ends = np.concatenate([ends, len(numbers) + np.cumsum([len(p) for p in parts])])
            words, numbers, plain = list(place), np.concatenate([numbers, more]), plain + rest
        memo = self.memo
        memo.make_room()
        found = memo.numbers(words)
        unknown = np.flatnonzero(found < 0)
        new = [words[at] for at in unknown.tolist()]
        short = [w for w in new if len(w) <= LONGEST]
        self._learn_words([w for w in short if w not in tokens])
        self._learn_tokens([w for w in short if w in tokens])
        kept = len(memo.known)
        if len(short) < len(new):
            self._learn_words([w for w in new if len(w) > LONGEST and w not in tokens])
            self._learn_tokens([w for w in new if len(w) > LONGEST and w in tokens])
        found[unknown] = memo.numbers(new)
        memo.met[found] += 1
        for at, ids in zip(plain, gathered(memo.ids, memo.start[found], memo.size[found], numbers, ends)):
            out[at] = ids
        memo.forget_after(kept)
        return out

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; none for null and empty texts."""
        out: list[bytes] = []
        held, chars = [], 0
        for text in texts:
            held.append(text)
            chars += len(text or "")
            if len(held) == GROUP or chars > GROUP_CHARS:
                out += self._group(held)
                held, chars = [], 0
        return out + self._group(held)


def numbered_words(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Different words of even texts, the number of each word in order, and where each text's words end.

    A word starts with a text, with a space, with a line feed (a word of its own) and after one.
    """
    if not texts:
        return [], np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    _, offsets, raw = pa.array(texts, pa.large_string()).buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[: len(texts) + 1]
    codes = np.frombuffer(raw, dtype=np.uint8)[: offsets[-1]]
    feeds = codes == 10
    begins = feeds | (codes == 32)
    begins[1:] |= feeds[:-1]
    begins[offsets[:-1]] = True
    starts = np.flatnonzero(begins)
    bounds = pa.py_buffer(np.append(starts, len(codes)).astype(np.int64))
    coded = pa.LargeStringArray.from_buffers(len(starts), bounds, raw).dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), np.searchsorted(starts, offsets[1:])


def runs(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of each run in turn, the ``size`` elements from ``start``."""
    upto = np.cumsum(size)
    return pool[np.arange(upto[-1] if len(upto) else 0) + np.repeat(start - upto + size, size)]


def gathered(pool: np.ndarray, start: np.ndarray, size: np.ndarray, numbers: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The ids of each text: those of its words, by their numbers."""
    parts, marks = [], [np.zeros(1, dtype=np.int64)]
    for at in range(0, len(numbers), GATHER):
        some = numbers[at : at + GATHER]
        parts.append(runs(pool, start[some], size[some]).tobytes())
        marks.append(marks[-1][-1] + np.cumsum(size[some]))
    joined, marks = b"".join(parts), np.concatenate(marks)
    cuts = [0, *(4 * marks[ends]).tolist()]
    return [joined[a:b] for a, b in zip(cuts, cuts[1:])]
