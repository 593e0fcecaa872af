"""Quality rules on whole texts: word statistics, and zstandard compression bands.

Repeated text compresses far better than prose, and random characters hardly compress at
all. A document is kept if the ratio of its compressed to its raw size lies in the band for
its length, and if nearly all of its chunks of fixed size do too.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, replace

import zstandard
from pyspark.sql import DataFrame

from headgrid.llm.common import filter_texts, map_texts

SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Bands:
    """Limits on compressed / raw size in bytes, by raw size.

    ``whole`` and ``chunk`` list (size, lowest ratio, highest ratio), sizes ascending; between two
    sizes the limits are interpolated over the logarithm of the size, above the last they stay.
    Texts or chunks below the first size are not judged: their ratio says little.
    The defaults suit any prose: highest ratios halfway between clean text and random letters
    and digits, lowest ratios that only heavy repetition falls below.
    """

    level: int = 3
    chunk_bytes: int = 4096
    #: Share of judged chunks that may lie outside their band.
    chunk_share: float = 0.25
    whole: tuple[tuple[int, float, float], ...] = (
        (128, 0.25, 1.03),
        (192, 0.25, 0.90),
        (256, 0.25, 0.86),
        (384, 0.25, 0.80),
        (512, 0.24, 0.76),
        (768, 0.23, 0.71),
        (1024, 0.22, 0.68),
        (1536, 0.21, 0.65),
        (2048, 0.20, 0.63),
        (4096, 0.19, 0.61),
        (8192, 0.18, 0.59),
        (32768, 0.16, 0.57),
    )
    chunk: tuple[tuple[int, float, float], ...] = ((1024, 0.20, 0.68), (2048, 0.20, 0.63), (4096, 0.19, 0.61))


BANDS = Bands()
#: Bytes of the prefixes that ``fit_bands`` compresses, and the fewest texts that give a limit.
SIZES, LEAST_TEXTS = (128, 192, 256, 384, 512, 768, 1024, 1536, 2048, 3072, 4096, 8192, 16384), 15
#: Margins below the lowest and above the highest ratio of clean text.
MARGINS = 0.03, 0.05


def fit_bands(clean: list[str], start: Bands = BANDS) -> Bands:
    """Limits from the lowest and highest ratio of prefixes of clean texts, with the margins."""
    packer = zstandard.ZstdCompressor(level=start.level)
    raws, whole = [t.encode("utf-8", "surrogatepass") for t in clean], []
    for size in SIZES:
        ratios = [len(packer.compress(raw[:size])) / size for raw in raws if len(raw) >= size]
        if len(ratios) >= LEAST_TEXTS:
            whole.append((size, round(min(ratios) * (1 - MARGINS[0]), 3), round(max(ratios) * (1 + MARGINS[1]), 3)))
    return replace(start, whole=tuple(whole), chunk=tuple(w for w in whole if 1024 <= w[0] <= start.chunk_bytes))


#: ``fit_bands`` of the documents of sf0.1 that are labelled good and pass the base rules. Fitted to this corpus:
#: much real prose, such as licence texts of 4 KB, lies below its lowest ratios.
CORPUS_BANDS = Bands(
    whole=(
        (128, 0.644, 1.017),
        (192, 0.621, 0.897),
        (256, 0.591, 0.845),
        (384, 0.561, 0.796),
        (512, 0.548, 0.753),
        (768, 0.508, 0.678),
        (1024, 0.487, 0.633),
        (1536, 0.465, 0.583),
        (2048, 0.457, 0.556),
        (3072, 0.438, 0.524),
        (4096, 0.43, 0.506),
        (8192, 0.415, 0.476),
        (16384, 0.399, 0.457),
    ),
    chunk=((1024, 0.487, 0.633), (1536, 0.465, 0.583), (2048, 0.457, 0.556), (3072, 0.438, 0.524), (4096, 0.43, 0.506)),
)
OUT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, zstd_ratio double, n_chunks long, n_bad_chunks long"
)


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at ASCII white space only
    chars = len(text) - sum(text.count(c) for c in " \t\n\v\f\r")
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = Counter(line for line in raw.split(b"\n") if line.split())
    repeated = 0
    if len(words) > WINDOW:
        windows = list(zip(*(words[i:] for i in range(WINDOW))))
        if len(set(windows)) < len(windows):
            counts, reach = Counter(windows), 0
            for at, window in enumerate(windows):
                if counts[window] > 1:
                    repeated += at + WINDOW - max(reach, at)
                    reach = at + WINDOW
    return len(words), chars, symbols, sum(lines.values()) - len(lines), repeated


def limits(size: int, bands) -> tuple[float, float] | None:
    """Lowest and highest ratio at ``size``, None if it is not judged."""
    if not bands or size < bands[0][0]:
        return None
    for (least, *lower), (most, *upper) in zip(bands, bands[1:]):
        if size < most:
            part = math.log(size / least) / math.log(most / least)
            return tuple(a + part * (b - a) for a, b in zip(lower, upper))
    return bands[-1][1:]


def _inside(size: int, ratio: float, bands) -> bool:
    found = limits(size, bands)
    return found is None or found[0] <= ratio <= found[1]


def compression(text: str | None, bands: Bands = BANDS) -> tuple[bool, float | None, int, int]:
    """Verdict, ratio of the whole text (None if empty), judged chunks, chunks outside their band."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return True, None, 0, 0
    packer = zstandard.ZstdCompressor(level=bands.level)
    ratio = len(packer.compress(raw)) / len(raw)
    chunks = bad = 0
    if len(raw) > bands.chunk_bytes:
        for at in range(0, len(raw), bands.chunk_bytes):
            chunk = raw[at : at + bands.chunk_bytes]
            if limits(len(chunk), bands.chunk):
                chunks += 1
                bad += not _inside(len(chunk), len(packer.compress(chunk)) / len(chunk), bands.chunk)
    return _inside(len(raw), ratio, bands.whole) and bad <= bands.chunk_share * chunks, ratio, chunks, bad


def judge(text: str | None, bands: Bands = BANDS) -> tuple:
    """The columns of ``OUT`` for one text."""
    counts = base_counts(text)
    failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
    good, ratio, chunks, bad = compression(text, bands)
    return *counts, failed, not failed and good, ratio, chunks, bad


def quality_rules(docs: DataFrame, bands: Bands = BANDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, the counts, base_failed, kept and the compression figures.

    * A null text counts as empty: no words, ``base_failed``, not kept, null ``zstd_ratio``.
    * Null ids and repeated rows stay, one output row each; other columns are not read.
    * Texts of any length are judged whole; an empty table gives an empty result.
    """
    return map_texts(docs, lambda texts: list(zip(*(judge(t, bands) for t in texts))) or [[]] * 10, OUT, (id_col,), text_col)


def keep_good(docs: DataFrame, bands: Bands = BANDS, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all columns."""
    return filter_texts(docs, lambda texts: [judge(t, bands)[6] for t in texts], text_col)
