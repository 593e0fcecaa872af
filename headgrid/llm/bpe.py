"""Byte-level BPE by a sentencepiece model that is written directly from a rank file.

Each byte is mapped to a printable character, so a vocabulary entry becomes a piece of such
characters. Piece number r is the entry of rank r, its score is -r; the model merges the pair
of highest score first, the leftmost of equals, as merging by rank does. The normaliser is the
identity. Texts are cut by the pattern first and each pre-token is encoded on its own. A
pre-token that is itself an entry is that entry, whether or not merges lead to it.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame

from headgrid.llm.chunks import ChunkEncoder
from headgrid.llm.common import map_texts

UNKNOWN = "<unk>"


def byte_characters() -> list[str]:
    """Printable character of each byte: itself if it is printable in Latin-1, else the next one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    table = {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Entries of a rank file, by rank. Ranks must be 0, 1, 2, ..."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(entry) for entry, rank in map(bytes.split, lines) if entry}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be consecutive and start at 0")
    return [ranks[i] for i in range(len(ranks))]


# Serialised model: protocol buffer wire format


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + np.float32(value).tobytes()
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialised_model(entries: list[bytes]) -> bytes:
    """A sentencepiece BPE model. Field numbers, kinds (1 normal, 2 unknown) and model type 2 (BPE) of its format."""
    of_byte = byte_characters()
    pieces = []
    for rank, entry in enumerate(entries):
        name = "".join(of_byte[b] for b in entry).encode()
        pieces.append(_field(1, _field(1, name) + _field(2, float(-rank)) + _field(3, 1)))
    pieces.append(_field(1, _field(1, UNKNOWN.encode()) + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(entries)) + _field(45, UNKNOWN.encode())
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encoder of one vocabulary; a worker keeps one for each."""

    def __init__(self, path: str, pattern: str):
        entries = read_ranks(path)
        self.rank = {e: i for i, e in enumerate(entries)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised_model(entries))
        self.mapped = str.maketrans({i: c for i, c in enumerate(byte_characters())})
        self.chunks = ChunkEncoder(pattern, self._merge)

    def _merge(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, an entry's own number or what the model merges, and how many each has."""
        different = list(dict.fromkeys(tokens))
        raw = [t.encode("utf-8", "surrogatepass") for t in different]
        ranks = [self.rank.get(r) for r in raw]
        merged = [r.decode("latin-1").translate(self.mapped) for r, known in zip(raw, ranks) if known is None]
        found = iter(self.model.encode(merged, num_threads=1) if merged else [])
        ids = {t: array("I", next(found) if known is None else [known]).tobytes() for t, known in zip(different, ranks)}
        parts = [ids[t] for t in tokens]
        return np.frombuffer(b"".join(parts), dtype="<u4"), np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return self.chunks.encode(texts)


def decode(entries: list[bytes], ids: bytes | None) -> bytes:
    """Inverse: the entries of the ids, which are their pieces with each character mapped back to its byte."""
    return b"".join([entries[i] for i in np.frombuffer(ids or b"", dtype="<u4").tolist()])


@lru_cache(maxsize=4)
def read_once(path: str) -> list[bytes]:
    return read_ranks(path)


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def bpe_encode(
    docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", out: str = "ids"
) -> DataFrame:
    """``keep`` and the ids of every whole text, little-endian unsigned 32-bit integers in one binary value.

    * ``path`` is a rank file that every executor can read; there are no special tokens.
    * Null and empty texts have no ids (an empty value). Repeated rows and null ids stay.
    * An empty table gives an empty result; other columns are not read.
    """

    def work(texts):
        return [codec(path, pattern).encode(texts)]

    return map_texts(docs, work, f"`{out}` binary", keep, text_col)


def bpe_decode(
    encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id", "ids"), ids_col: str = "ids", out: str = "bytes"
) -> DataFrame:
    """``keep`` and the bytes that the ids stand for. Null ids are none; an id outside the vocabulary is an error."""

    def work(values):
        entries = read_once(path)
        return [[decode(entries, v) for v in values]]

    return map_texts(encoded, work, f"`{out}` binary", keep, ids_col)


def bpe_round_trip(
    docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text"
) -> DataFrame:
    """``keep``, ids as ``bpe_encode`` makes them, and the bytes decoded from them, with one worker for both."""

    def work(texts):
        ids, entries = codec(path, pattern).encode(texts), read_once(path)
        return [ids, [decode(entries, i) for i in ids]]

    return map_texts(docs, work, "ids binary, bytes binary", keep, text_col)
