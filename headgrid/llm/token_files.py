"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds the ids (little-endian unsigned 32-bit integers) of consecutive documents in
frames that can be decompressed on their own, then two skippable frames:

* the document index: for each document its id, frame, first id within the frame and number of ids;
* the seek table of the public zstd seekable format: compressed size, size and checksum (low
  32 bits of XXH64) of every frame, their number, and the closing magic number.

A reader opens the end of a file, finds the document and decompresses its frame only. Frames
end with a document once they hold ``frame_ids`` ids; a longer document has frames of its own.

Files are written by the tasks through pyarrow's file systems to a folder that all executors
share, under a name of their own for each attempt; a manifest table, written last, names the
files that count. A repeated or speculative task therefore leaves at most an unnamed file.
"""

from __future__ import annotations

import os
import struct
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import tokenizers
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from headgrid.llm.bpe import byte_characters
from headgrid.llm.chunks import ChunkEncoder
from headgrid.llm.common import arrow_map

FRAME_IDS = 1 << 16
LEVEL = 3
#: Words that a worker remembers: the library is slow on new ones.
MEMO = 650_000
#: Most tasks that read files; each reads its files one after the other.
READ_TASKS = 10_000
#: Fixed values of the seekable format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_MAGIC, CHECKSUM_FLAG = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 1 << 7
#: Of a document: id, whether it has one, frame of its first id, place within the frame, number of ids.
INDEX = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("frame", "<u4"), ("at", "<u4"), ("n", "<u8")])
FRAME = np.dtype([("packed", "<u4"), ("size", "<u4"), ("checksum", "<u4")])


def _checksum(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


class Writer:
    """Writes one file; ``add`` takes documents in order, ``close`` adds index and seek table."""

    def __init__(self, sink, frame_ids: int = FRAME_IDS, level: int = LEVEL):
        self.sink, self.most = sink, frame_ids * 4
        self.packer = zstandard.ZstdCompressor(level=level)
        self.frames, self.docs, self.held = [], [], bytearray()

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.held and len(self.held) + len(ids) > self.most:
            self._frame()
        self.docs.append((doc_id or 0, doc_id is not None, len(self.frames), len(self.held) // 4, len(ids) // 4))
        self.held += ids
        while len(self.held) >= self.most:
            self._frame()

    def _frame(self) -> None:
        raw = bytes(self.held[: self.most])
        del self.held[: self.most]
        packed = self.packer.compress(raw)
        self.frames.append((len(packed), len(raw), _checksum(raw)))
        self.sink.write(packed)

    def close(self) -> None:
        while self.held:
            self._frame()
        index = np.array(self.docs, dtype=INDEX).tobytes()
        # a skippable frame's size has 32 bits: a long index takes several
        parts = [index[i : i + (1 << 30) // INDEX.itemsize * INDEX.itemsize] for i in range(0, len(index), (1 << 30) // INDEX.itemsize * INDEX.itemsize)]
        for part in parts or [b""]:
            self.sink.write(struct.pack("<II", SKIPPABLE_INDEX, len(part)) + part)
        body = np.array(self.frames, dtype=FRAME).tobytes() + struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK, len(body)) + body)
        self.sink.close()


class Reader:
    """Reads index and seek table, and then only the frames of the documents asked for."""

    def __init__(self, source, size: int):
        self.source = source
        count, flag, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEK_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError("no seek table")
        start = size - 9 - count * FRAME.itemsize
        self.frames = np.frombuffer(self._read(start, count * FRAME.itemsize), dtype=FRAME)
        self.offsets = np.concatenate([[0], np.cumsum(self.frames["packed"].astype(np.int64))])
        at, parts = int(self.offsets[-1]), []
        while at < start - 8:
            kind, length = struct.unpack("<II", self._read(at, 8))
            if kind != SKIPPABLE_INDEX:
                raise ValueError("no document index")
            parts.append(self._read(at + 8, length))
            at += 8 + length
        self.docs = np.frombuffer(b"".join(parts), dtype=INDEX)
        self.unpacker = zstandard.ZstdDecompressor()
        self.last: tuple[int, bytes] = (-1, b"")

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            raw = self.unpacker.decompress(self._read(int(self.offsets[k]), int(self.frames["packed"][k])), int(self.frames["size"][k]))
            if _checksum(raw) != self.frames["checksum"][k]:
                raise ValueError(f"frame {k} is damaged")
            self.last = k, raw
        return self.last[1]

    def ids(self, row: int) -> bytes:
        """Ids of the document in a row of the index."""
        doc = self.docs[row]
        k, at, left, out = int(doc["frame"]), int(doc["at"]) * 4, int(doc["n"]) * 4, []
        while left:
            part = self.frame(k)[at : at + left]
            if not part:
                raise ValueError("the file ends within a document")
            out.append(part)
            left, k, at = left - len(part), k + 1, 0
        return b"".join(out)

    def find(self, doc_id: int) -> list[bytes]:
        """Ids of every document with this id. Documents are in ascending order, unknown ids first."""
        known = self.docs["known"] > 0
        first = int(np.searchsorted(known, True))
        low, high = (first + int(np.searchsorted(self.docs["doc_id"][first:], doc_id, side)) for side in ("left", "right"))
        return [self.ids(row) for row in range(low, high)]


def open_file(path: str) -> Reader:
    system, inner = pyarrow.fs.FileSystem.from_uri(path)
    return Reader(system.open_input_file(inner), system.get_file_info(inner).size)


@lru_cache(maxsize=4)
def encoder(vocabulary: str, pattern: str) -> ChunkEncoder:
    """Encoder of a byte-level vocabulary of the tokenizers library; one a worker.

    New pre-tokens are handed to the library's model together, their bytes already mapped to its
    characters and separated by line feeds, which no mapped text holds; the lengths of the
    entries tell which ids belong to which. Texts that may hold the name of a special token, or
    that can't be cut into words, go through the library's own pipeline.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    own, model = (tokenizers.Tokenizer.from_file(vocabulary) for _ in range(2))
    model.pre_tokenizer = tokenizers.pre_tokenizers.WhitespaceSplit()
    special = tuple(t.content for t in own.get_added_tokens_decoder().values())
    mapped = np.array([ord(c) for c in byte_characters()], dtype="<u4")
    mapped[10] = 10
    entries = own.get_vocab()
    length = np.zeros(max(entries.values()) + 1, dtype=np.int64)
    for entry, number in entries.items():
        length[number] = len(entry)

    def whole(texts):
        return [np.array(e.ids, dtype="<u4").tobytes() for e in own.encode_batch_fast(texts, add_special_tokens=False)]

    def merge(tokens):
        raw = np.frombuffer("\n".join(tokens).encode("utf-8", "surrogatepass"), dtype=np.uint8)
        feeds = np.flatnonzero(raw == 10)
        if len(feeds) >= len(tokens):  # some hold line feeds
            found = whole(tokens)
            return np.frombuffer(b"".join(found), dtype="<u4"), np.array([len(f) // 4 for f in found], dtype=np.int64)
        text = mapped[raw].tobytes().decode("utf-32-le")
        ids = np.array(model.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        upto = np.append(feeds, len(raw)) - np.arange(len(tokens))
        return ids, np.diff(np.searchsorted(np.cumsum(length[ids]), upto) + 1, prepend=0)

    return ChunkEncoder(pattern, merge, whole, lambda text: any(s in text for s in special), MEMO)


def write_token_files(
    docs: DataFrame,
    folder: str,
    vocabulary: str,
    pattern: str,
    end_id: int = 0,
    frame_ids: int = FRAME_IDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write the ids of every text, ``end_id`` after each, in ascending order of ids; returns the manifest.

    Manifest: file, whether a document with an id is in it, its smallest id, documents, ids. It is
    stored as Parquet in ``folder``/manifest once all files are there. The texts are dealt out by
    ranges of ids, so that a file is one range; each task holds one batch of texts.

    * Null and empty texts have the end id only. Null ids come first; repeated ids are all
      kept, ordered by a hash of their text.
    * An empty table gives no files and an empty manifest.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(F.asc_nulls_first("doc_id"), F.xxhash64("text"))
    ordered = ordered.sortWithinPartitions(F.asc_nulls_first("doc_id"), F.xxhash64("text"))
    end = np.array([end_id], dtype="<u4").tobytes()

    def write(batches):
        writer, count, total, low, low_key = None, 0, 0, None, None
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc_id, found in zip(ids, encoder(vocabulary, pattern).encode(texts)):
                if writer is None:
                    path = f"{folder}/ids-{uuid.uuid4().hex}.zst"
                    system, inner = pyarrow.fs.FileSystem.from_uri(path)
                    system.create_dir(os.path.dirname(inner), recursive=True)
                    writer = Writer(system.open_output_stream(inner, compression=None), frame_ids)
                    low, low_key = doc_id, xxhash.xxh64_intdigest((texts[0] or "").encode("utf-8", "surrogatepass"), 42)
                writer.add(doc_id, found + end)
                count, total = count + 1, total + len(found) // 4 + 1
        if writer is not None:
            writer.close()
            signed = low_key - (1 << 64) if low_key >> 63 else low_key
            yield pa.RecordBatch.from_pylist([{"file": path, "first_id": low, "first_key": signed, "n_docs": count, "n_ids": total}], schema=_MANIFEST)

    manifest = arrow_map(ordered, write, "file string, first_id long, first_key long, n_docs long, n_ids long")
    manifest.write.parquet(f"{folder}/manifest")
    return read_manifest(docs.sparkSession, folder)


_MANIFEST = pa.schema([("file", pa.string()), ("first_id", pa.int64()), ("first_key", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The files in order, with the number of ids in the files before each. One row a file."""
    schema = StructType.fromDDL("file string, first_id long, first_key long, n_docs long, n_ids long")
    files = spark.read.schema(schema).parquet(f"{folder}/manifest")
    order = Window.orderBy(F.asc_nulls_first("first_id"), "first_key").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(order), F.lit(0).cast("long")))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids of every document, read from the files.

    ``start`` counts the ids of all documents before; ``ids`` are little-endian unsigned 32-bit.
    """
    files = manifest.repartition(max(1, min(manifest.count(), READ_TASKS)), "file")

    def read(batches):
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = open_file(file)
                starts = start + np.concatenate([[0], np.cumsum(reader.docs["n"].astype(np.int64))])
                known = reader.docs["known"] > 0
                for at in range(0, len(reader.docs), 256):
                    rows = range(at, min(at + 256, len(reader.docs)))
                    part = reader.docs[at : at + 256]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(part["doc_id"], mask=~known[at : at + 256]),
                            pa.array(starts[at : at + len(part)]),
                            pa.array(part["n"].astype(np.int64)),
                            pa.array([reader.ids(r) for r in rows], pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    return arrow_map(files.select("file", "start"), read, "doc_id long, start long, n_tokens long, ids binary")


def read_documents(manifest: DataFrame, wanted: list[int]) -> DataFrame:
    """doc_id and ids of the documents in a list of ids; only their frames are decompressed."""
    ids = sorted(set(wanted))

    def read(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                reader = open_file(file)
                found = [(i, x) for i in ids for x in reader.find(i)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())], names=["doc_id", "ids"])

    return arrow_map(manifest.select("file"), read, "doc_id long, ids binary")
