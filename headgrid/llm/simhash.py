"""SimHash near-duplicate groups, found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments A and B of 23 bits and C of 18. The perfect
(23, 12) Golay code assigns every 23-bit word to the one codeword within three bits. The
codewords of a word and of its 23 neighbours at one bit make its *keys* (one key, or six
when the word is three bits off). Two words at most two bits apart have a word between
them that is a neighbour of both, so they share a key. Four differing bits, a in A, b in
B and c in C, leave these cases, each with its own kind of bucket key:

====================  =======================================================
a, b and c at most 2  key of A, key of B, one of three equal 6-bit blocks of C
c of 3 or 4           a + b <= 1: A equal and key of B, or key of A and B equal
a of 3 or 4           b + c <= 1: B and a half of C equal, or key of B and C equal
b of 3 or 4           the same with A in place of B
====================  =======================================================

So every pair within four bits meets in a bucket of at least 30 bits; there the distance
is verified. About 109 keys are made for each *different* fingerprint.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from headgrid.llm.common import arrow_map, fresh, map_texts, stored

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: Members of one bucket that a task compares at once; larger buckets are dealt out in pairs of blocks of this size.
BLOCK = 20_000
#: Generator polynomial of the Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011
LOW_23 = (1 << 23) - 1


# Fingerprints


def shingles(text: str | None, size: int = SHINGLE) -> list[bytes]:
    """Runs of ``size`` words, repeats included; the whole sequence if there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return []
    if len(words) <= size:
        return [b" ".join(words)]
    return [b" ".join(s) for s in zip(*(words[i:] for i in range(size)))]


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half of the shingles' XXH64; 0 without words."""
    found = shingles(text, size)
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(found), 1 << 16):
        hashes = np.array([digest(s, SEED) for s in found[at : at + (1 << 16)]], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(found), bitorder="little").view("<u8")[0])


def simhash_fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, keep: tuple[str, ...] = ()
) -> DataFrame:
    """``id_col``, ``keep`` and the fingerprint as a (signed) long, one row per row of ``docs``."""

    def work(texts):
        return [np.array([fingerprint(t, shingle) for t in texts], dtype="<u8").view("<i8")]

    return map_texts(docs, work, "fingerprint long", (id_col, *keep), text_col)


# Golay keys


@lru_cache(maxsize=1)
def _tables():
    """Syndromes of the low 12 and the high 11 bits, and the error (of at most three bits) of each syndrome."""

    def remainder(v):
        for i in range(22, 10, -1):
            if v >> i & 1:
                v ^= GOLAY << (i - 11)
        return v

    low = np.array([remainder(v) for v in range(1 << 12)], dtype=np.int64)
    high = np.array([remainder(v << 12) for v in range(1 << 11)], dtype=np.int64)
    errors = np.zeros(1 << 11, dtype=np.int64)
    singles = [1 << i for i in range(23)]
    for i, a in enumerate(singles):
        errors[remainder(a)] = a
        for j in range(i):
            errors[remainder(a | singles[j])] = a | singles[j]
            for k in range(j):
                errors[remainder(a | singles[j] | singles[k])] = a | singles[j] | singles[k]
    return low, high, errors


def golay_index(words: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword within three bits of each 23-bit word."""
    low, high, errors = _tables()
    return (words ^ errors[low[words & 0xFFF] ^ high[words >> 12]]) >> 11


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each word, (n, 24), and which of them are its different ones."""
    near = np.concatenate([words[:, None], words[:, None] ^ (1 << np.arange(23, dtype=np.int64))], axis=1)
    found = np.sort(golay_index(near), axis=1)
    first = np.ones(found.shape, dtype=bool)
    first[:, 1:] = found[:, 1:] != found[:, :-1]
    return found, first


def bucket_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row number) of every bucket that the fingerprints belong to."""
    v = prints.astype("<i8").view("<u8")
    a, b = (v & LOW_23).astype(np.int64), (v >> np.uint64(23) & LOW_23).astype(np.int64)
    c = (v >> np.uint64(46)).astype(np.int64)
    (ka, fa), (kb, fb) = golay_keys(a), golay_keys(b)
    keys, rows = [], []

    def add(kind, key, row):
        keys.append(kind << 58 | key)
        rows.append(row)

    every = np.arange(len(v))
    row_a, col_a = np.nonzero(fa)
    row_b, col_b = np.nonzero(fb)
    key_a, key_b = ka[row_a, col_a], kb[row_b, col_b]
    per_b, start_b = fb.sum(axis=1), np.concatenate([[0], np.cumsum(fb.sum(axis=1))[:-1]])
    times = per_b[row_a]  # each key of A with every key of B of the same row
    row_ab = np.repeat(row_a, times)
    offset = np.arange(len(row_ab)) - np.repeat(np.cumsum(times) - times, times)
    key_ab = np.repeat(key_a, times) << 12 | key_b[start_b[row_ab] + offset]
    for i in range(3):
        add(i, (c >> 6 * i & 63)[row_ab] << 24 | key_ab, row_ab)
    add(3, a[row_b] << 12 | key_b, row_b)
    add(4, b[row_a] << 12 | key_a, row_a)
    add(7, c[row_b] << 12 | key_b, row_b)
    add(10, c[row_a] << 12 | key_a, row_a)
    for half in (0, 1):
        add(5 + half, (c >> 9 * half & 511) << 23 | b, every)
        add(8 + half, (c >> 9 * half & 511) << 23 | a, every)
    return np.concatenate(keys), np.concatenate(rows)


# Links


def spanning(prints: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """(smallest, other) for the members of each connected set of two or more.

    Each member is compared once with those that are still unreached, so a dense group
    costs little more than one pass.
    """
    left, out = np.sort(prints), []
    while len(left) > 1:
        root, left = left[0], left[1:]
        edge = np.array([root])
        while len(edge) and len(left):
            step = max(1, 4_000_000 // len(left))
            part, edge = edge[:step], edge[step:]
            near = (np.bitwise_count((part[:, None] ^ left[None, :]).view("<u8")) <= max_bits).any(axis=0)
            if near.any():
                hit, left = left[near], left[~near]
                out += [(int(root), int(h)) for h in hit]
                edge = np.concatenate([edge, hit])
    return out


_LINKS = "a long, b long, bucket long, block int"


def _link_runs(max_bits: int, block: int):
    """Over rows sorted by bucket: links (a, b); members of larger buckets as (a, null, bucket, block)."""

    def run(batches):
        bucket, number = None, 0  # the bucket whose members were begun to be put out in blocks
        carry = (np.empty(0, "<i8"), np.empty(0, "<i8"))

        def table(a, b=None, key=None, block_no=None):
            n = len(a)
            null = pa.nulls
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(a, pa.int64()),
                    null(n, pa.int64()) if b is None else pa.array(b, pa.int64()),
                    null(n, pa.int64()) if key is None else pa.array(np.full(n, key), pa.int64()),
                    null(n, pa.int32()) if block_no is None else pa.array(np.full(n, block_no), pa.int32()),
                ],
                names=["a", "b", "bucket", "block"],
            )

        def whole(keys, prints):
            """Links of the complete runs."""
            cuts = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
            sizes = ends - starts
            two = starts[sizes == 2]
            x, y = prints[two], prints[two + 1]
            near = np.bitwise_count((x ^ y).view("<u8")) <= max_bits
            found = [(np.minimum(x, y)[near], np.maximum(x, y)[near])]
            more = [e for s, t in zip(starts[sizes > 2], ends[sizes > 2]) for e in spanning(prints[s:t], max_bits)]
            if more:
                found.append(tuple(np.array(more, dtype="<i8").T))
            a, b = (np.concatenate(f) for f in zip(*found))
            if len(a):
                pairs = np.unique(np.stack([a, b], axis=1), axis=0)
                yield table(pairs[:, 0], pairs[:, 1])

        for batch in batches:
            keys = np.concatenate([carry[0], batch.column("bucket").to_numpy()])
            prints = np.concatenate([carry[1], batch.column("fingerprint").to_numpy()])
            if not len(keys):
                continue
            if bucket is not None:  # the rest of a large bucket
                same = int(np.searchsorted(keys != bucket, True)) if keys[-1] != bucket else len(keys)
                for at in range(0, same, block):
                    yield table(prints[at : min(at + block, same)], None, bucket, number)
                    number += 1
                keys, prints = keys[same:], prints[same:]
                if not len(keys):
                    carry = (keys, prints)
                    continue
                bucket = None
            last = int(np.searchsorted(keys == keys[-1], True)) if keys[0] != keys[-1] else 0
            if last:
                yield from whole(keys[:last], prints[:last])
            carry = (keys[last:], prints[last:])
            if len(carry[0]) > block:
                bucket, number = int(carry[0][0]), 0
                for at in range(0, len(carry[1]), block):
                    yield table(carry[1][at : at + block], None, bucket, number)
                    number += 1
                carry = (carry[0][:0], carry[1][:0])
        if len(carry[0]):
            yield from whole(*carry)

    return run


def _emit_keys(batches):
    for batch in batches:
        prints = batch.column(0).to_numpy()
        for at in range(0, len(prints), 4096):
            part = prints[at : at + 4096]
            keys, rows = bucket_keys(part)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], names=["bucket", "fingerprint"])


def fingerprint_links(prints: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect the different fingerprints of ``prints`` within ``max_bits`` bits.

    Buckets are sorted and streamed. One of over ``block`` members is put out in blocks, whose
    pairs other tasks compare, so no task holds more than two blocks.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the bucket keys are exact for up to {MAX_BITS} bits")
    keyed = arrow_map(prints.select("fingerprint"), _emit_keys, "bucket long, fingerprint long")
    runs = keyed.repartition("bucket").sortWithinPartitions("bucket", "fingerprint")
    found = stored(arrow_map(runs, _link_runs(max_bits, block), _LINKS), "links")
    links = found.where("b is not null").select("a", "b")
    large = found.where("b is null")
    if large.limit(1).count():
        blocks = large.groupBy("bucket").agg((F.max("block") + 1).alias("blocks"))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        paired = large.join(blocks, "bucket").select("a", "bucket", "block", other)
        dealt = paired.select(
            F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")).alias("bucket"),
            F.col("a").alias("fingerprint"),
        )
        runs = dealt.repartition("bucket").sortWithinPartitions("bucket")
        links = links.union(arrow_map(runs, _link_runs(max_bits, 1 << 62), _LINKS).select("a", "b"))
    return links.distinct()


# Components


def connected(links: DataFrame, name: str = "stars") -> DataFrame:
    """(node, root): the smallest node that each linked node can reach.

    Alternates large and small stars until nothing changes; each round is written to
    the shared folder. Nothing is collected but two numbers a round.
    """

    def tidy(df):
        high, low = F.greatest("x", "y"), F.least("x", "y")
        return df.where("x <> y").select(high.alias("u"), low.alias("v")).distinct()

    def sign(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    edges = stored(tidy(links.toDF("x", "y")), name)
    seen = sign(edges)
    while seen[0]:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = tidy(both.join(low, "u").where("v > u").select(F.col("v").alias("x"), F.col("m").alias("y")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("x"), F.col("m").alias("y"))
        edges = stored(tidy(small), name)
        now = sign(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def simhash_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``keep``, fingerprint (long), component_id and root.

    Documents are linked when their fingerprints differ in at most ``max_bits`` bits;
    ``component_id`` is the smallest id that links reach, the row's own included; ``root`` is
    the smallest fingerprint of the component.

    * Null and empty texts, and those of white space, have fingerprint 0 and are linked like others.
    * Repeated rows and ids stay, one output row each. A null id is no candidate for the smallest;
      a component without any other id has a null ``component_id``.
    * An empty table gives an empty result; other columns are not read.
    """
    prints = stored(simhash_fingerprints(docs, id_col, text_col, shingle, keep), "fingerprints")
    firsts = prints.groupBy("fingerprint").agg(F.min(id_col).alias("first"))
    roots = connected(fingerprint_links(firsts, max_bits))
    rooted = firsts.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "fingerprint"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = rooted.join(smallest, "root").select("fingerprint", "component_id", "root")
    return prints.join(of_print, "fingerprint").select(id_col, *keep, "fingerprint", "component_id", "root")


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest id, then the smallest text hash.

    Rows that are equal in id and text are one document, of which one row stays. A null id
    comes last. All columns are kept; texts are shuffled once.
    """
    who, key = fresh(docs, "row_id"), fresh(docs, "text_key")
    keyed = docs.withColumns(
        {
            who: F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit("n")),
            key: F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))),
        }
    )
    groups = simhash_components(keyed, id_col, text_col, shingle, max_bits, keep=(who, key))
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), F.col(key), F.col(who))
    winners = groups.groupBy("root").agg(F.min(order).alias("m")).select(f"m.{who}", f"m.{key}")
    return keyed.dropDuplicates([who, key]).join(winners, [who, key], "left_semi").select(*docs.columns)
