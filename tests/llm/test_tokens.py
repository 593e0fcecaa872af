"""Encodings against the libraries they reproduce, and the file format."""

import base64
import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers
import zstandard

import corpus_pipeline
from headgrid.llm import bpe, chunks, quality_rules, queries, token_files
from headgrid.llm.common import scratch

RANKS, PATTERN = queries.MULTI_RANKS, public_tokenizers.PATTERN
SMALL = "/root/testdata/sf0.001"


def odd_texts():
    draw = random.Random(1)
    texts = ["", "  a  b\n\n c  ", "\x1c\x1d a\x85b\xa0c", "don't I'll we'd  'S", "a" * 3000, "中文 テスト 🙂🙂  12345 ٣٤", "\t\ttab\r\nx \n y", " lead", "trail ", "nul\x00 x", "x <|endoftext|> y"]
    return texts + ["".join(draw.choice("ab cd'st \n\t.,!12é中🙂\xa0\x1c\x85  llve") for _ in range(draw.randint(0, 40))) for _ in range(1500)]


@pytest.fixture(scope="module")
def texts(spark):
    return odd_texts() + [r[0] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]


def ints(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_bpe_equals_tiktoken(texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.codec(RANKS, PATTERN)
    found = own.encode(texts)
    assert [ints(f) for f in found] == [library.encode_ordinary(t) for t in texts]
    entries = bpe.read_ranks(RANKS)
    assert [bpe.decode(entries, f) for f in found] == [t.encode() for t in texts]


def test_token_encoder_equals_library(texts):
    library = tokenizers.Tokenizer.from_file(queries.BYTE_VOCABULARY)
    found = token_files.encoder(queries.BYTE_VOCABULARY, PATTERN).encode(texts)
    assert [ints(f) for f in found] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_full_memory_keeps_frequent_words():
    """Words met in many groups are merged once, however many others fill the memory."""
    merged = []

    def merge(tokens):
        merged.extend(tokens)
        parts = [np.frombuffer(t.encode("utf-32-le"), "<u4") for t in tokens]
        return np.concatenate(parts), np.array([len(p) for p in parts])

    own = chunks.ChunkEncoder(PATTERN, merge, memo=64)
    often, long = [chr(97 + i) * 3 for i in range(20)], "x" * (chunks.LONGEST + 1)
    for group in range(30):
        rare = [f"{a}{b}" for a in "pqrst" for b in [chr(0x4E00 + 10 * group + i) for i in range(6)]]
        texts = [" ".join(often) + "\n" + " ".join(rare), f"a  {long} b\t\n", None, f"y {long}, {long}\n.", ""]
        found = own.encode(texts)
        assert [f.decode("utf-32-le") for f in found] == [t or "" for t in texts]
        assert len(own.memo.known) <= 64 + 70 and f" {long}" not in own.memo.known
    assert all(merged.count(" " + w) == 1 for w in often[1:])


def test_bpe_frames(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "x y"), (3, "x y"), (4, "w " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' as bytes", "1 as n_tokens")
    ids = bpe.bpe_encode(docs, RANKS, PATTERN)
    back = bpe.bpe_decode(ids, RANKS).collect()
    assert sorted((str(r["doc_id"]), bytes(r["bytes"])) for r in back) == sorted((str(i), (t or "").encode()) for i, t in rows)
    assert bpe.bpe_encode(docs.limit(0), RANKS, PATTERN).collect() == []


def write(spark, rows, name, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return token_files.write_token_files(docs, scratch(docs, name), queries.BYTE_VOCABULARY, PATTERN, **more)


def test_token_files_round_trip(spark):
    draw = random.Random(2)
    rows = [(draw.randint(0, 200), " ".join(draw.choices(["alpha", "beta,", "été"], k=draw.randint(0, 400)))) for _ in range(150)]
    rows += [(None, "nobody"), (7, None), (8, ""), (9, "long " * 30_000)]
    manifest = write(spark, rows, "round-trip", frame_ids=256)
    found = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r["start"])
    library = tokenizers.Tokenizer.from_file(queries.BYTE_VOCABULARY)
    want = sorted((i is not None, i or 0, library.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in rows)
    assert [r["doc_id"] for r in found] == [i if known else None for known, i, _ in want]
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, ints(r["ids"])) for r in found) == want
    start = 0
    for r in found:
        assert (r["start"], r["n_tokens"]) == (start, len(ints(r["ids"])))
        start += r["n_tokens"]
    some = token_files.read_documents(manifest, [7, 9, 1000]).collect()
    assert {r["doc_id"] for r in some} == {7, 9}


def test_frames_are_independent_and_checked(spark):
    manifest = write(spark, [(i, f"document number {i} " * 20) for i in range(40)], "frames", frame_ids=200)
    path = manifest.first()["file"].removeprefix("file:")
    raw = open(path, "rb").read()
    count, flag, magic = struct.unpack("<IBI", raw[-9:])
    assert magic == 0x8F92EAB1 and flag == 128 and count > 3
    table = np.frombuffer(raw[-9 - count * 12 : -9], "<u4").reshape(-1, 3)
    at = int(table[:2, 0].sum())
    third = zstandard.ZstdDecompressor().decompress(raw[at : at + int(table[2, 0])])
    assert len(third) == table[2, 1]
    assert len(zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()) == int(table[:, 1].sum())
    reader = token_files.open_file(path)
    reads = []
    plain = reader._read
    reader._read = lambda a, n: reads.append(n) or plain(a, n)
    reader.ids(len(reader.docs) - 1)
    assert len(reads) <= 2
    damaged = bytearray(raw)
    damaged[-9 - count * 12 + 8] ^= 1  # checksum of the first frame
    open(path, "wb").write(bytes(damaged))
    with pytest.raises(ValueError, match="damaged"):
        token_files.open_file(path).frame(0)


def test_no_documents_no_files(spark):
    manifest = write(spark, [], "empty")
    assert manifest.count() == 0 and token_files.read_token_files(manifest).count() == 0


def test_queries_digest_columns(spark):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    library = tokenizers.Tokenizer.from_file(queries.BYTE_VOCABULARY)
    for r in queries.REGISTRY["op7_token_files"](spark, SMALL).collect():
        ids = library.encode(rows[r["doc_id"]], add_special_tokens=False).ids + [0]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes()) and r["n_tokens"] == len(ids)
    for r in queries.REGISTRY["op5_bpe"](spark, SMALL).collect():
        assert r["decoded_sha256"] == hashlib.sha256(rows[r["doc_id"]].encode()).hexdigest()


def test_pipeline(spark):
    got = corpus_pipeline.run(spark, SMALL).collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    good = [r for r in docs if quality_rules.judge(r["text"])[6]]
    last = {}
    for r in good:
        last[r["text"]] = max(r["doc_id"], last.get(r["text"], -1))
    assert {r["doc_id"] for r in got} <= set(last.values()) and len(got) > 0.8 * len(last)
    text = {r["doc_id"]: r["text"] for r in docs}
    assert all(r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest() for r in got)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_any_documents(spark, name, stage):
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (None, "a b c", "en", "s", 3), (3, "x y", "en", "s", 3), (3, "x y", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = stage(spark, docs, SMALL)
    assert name == "bpe" or out.columns == docs.columns
    out.collect()
    assert stage(spark, docs.limit(0), SMALL).collect() == []
