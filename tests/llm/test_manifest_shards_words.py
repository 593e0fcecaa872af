"""Manifest, shards and spelling variants against brute force, with nulls, ties, repeats and clashing names."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from headgrid.llm import hilbert, merkle, queries, spelling

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def odd_rows(n=60, seed=3):
    """Null ids, texts, languages and lengths, equal ids, rows equal throughout, empty and long texts."""
    rng = random.Random(seed)
    texts = [None, "", "ein Wort", "größer\r\n", "x" * 200_000, "same text"]
    rows = [
        (rng.choice([None, i, i, i, 7]), rng.choice(texts), rng.choice([None, "de", "en", "en", "zh"]), rng.choice([None, "a", "b"]), rng.choice([None, 0, i]))
        for i in range(n)
    ]
    return rows + [(7, "same text", "en", "a", 9)] * 25


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(leaves, arity):
    """Levels of nodes from the leaves to the root."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([H(*below[i : i + arity]) for i in range(0, len(below), arity)])
    return levels


def way(levels, rank, arity):
    out = []
    for nodes in levels[:-1]:
        first = rank // arity * arity
        out.append(("".join(nodes[first:rank]), "".join(nodes[rank + 1 : first + arity])))
        rank //= arity
    return out


def brute_proofs(rows, arity):
    groups = collections.defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        groups[lang].append((doc_id, H(*map(field, (doc_id, source, lang, n_chars, text)))))
    names = sorted(groups, key=lambda g: (g is not None, g or ""))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = tree([leaf for _, leaf in groups[g]], arity)
    upper = tree([trees[g][-1][0] for g in names], arity)
    for at, g in enumerate(names):
        for rank, (doc_id, leaf) in enumerate(groups[g]):
            yield doc_id, leaf, trees[g][-1][0], upper[-1][0], way(trees[g], rank, arity) + way(upper, at, arity)


@pytest.mark.parametrize("arity, children", [(2, 256), (2, 4), (3, 9)])
def test_proofs_equal_brute_force(spark, monkeypatch, arity, children):
    monkeypatch.setattr(merkle, "RECORD_CHILDREN", children)
    rows = odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as rank", "1 as tree", "2 as digest")
    found = merkle.prove(merkle.build_manifest(docs, COLUMNS, arity=arity)).collect()
    got = sorted((str(r.id), r.leaf, r.subroot, r.root, str([tuple(p) for p in r.path])) for r in found)
    assert got == sorted((str(i), leaf, sub, root, str(path)) for i, leaf, sub, root, path in brute_proofs(rows, arity))


def test_folding_finds_tampered_leaves_and_records_are_shared(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    manifest = merkle.build_manifest(docs, COLUMNS)
    found = merkle.prove(manifest).withColumn("ok", merkle.fold(F.col("leaf"), F.col("path")) == F.col("root"))
    assert found.where("not ok").isEmpty()
    other = merkle.fold(F.sha2(F.lit("other"), 256), F.col("path")) == F.col("root")
    assert found.where(other).isEmpty()
    assert manifest.records.groupBy("digest").count().where("count > 1").isEmpty()


def test_some_leaves_can_be_asked(spark):
    manifest = merkle.build_manifest(spark.createDataFrame(odd_rows(), SCHEMA), COLUMNS)
    few = manifest.leaves.where("rank % 5 = 3")
    found = merkle.prove(manifest, few)
    assert found.count() == few.count() > 0
    assert found.where(merkle.fold(F.col("leaf"), F.col("path")) != F.col("root")).isEmpty()


def test_one_leaf_and_no_leaf(spark):
    row = spark.createDataFrame([(1, "a", "en", "s", 1)], SCHEMA)
    only = merkle.prove(merkle.build_manifest(row, COLUMNS)).first()
    assert only.leaf == only.subroot == only.root and only.path == []
    assert merkle.prove(merkle.build_manifest(row.limit(0), COLUMNS)).count() == 0


def skilling(point, bits):
    """Place on the curve, with the axes turned one bit at a time."""
    x, n = list(point), len(point)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            if x[i] >> b & 1:
                x[0] ^= low
            else:
                t = (x[0] ^ x[i]) & low
                x[0] ^= t
                x[i] ^= t
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = 0
    for b in range(bits - 1, 0, -1):
        if x[-1] >> b & 1:
            t ^= (1 << b) - 1
    place = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            place = place << 1 | ((v ^ t) >> b & 1)
    return place


@pytest.mark.parametrize("axes, bits", [(2, 4), (3, 3), (4, 2), (1, 5)])
def test_curve_visits_every_cell_in_unit_steps(spark, axes, bits):
    side = 1 << bits
    cells = [tuple(c) for c in itertools.product(range(side), repeat=axes)]
    names = [f"x{i}" for i in range(axes)]
    frame = spark.createDataFrame(cells, names).withColumn("at", hilbert.hilbert_index([F.col(c) for c in names], bits))
    walk = [tuple(r)[:-1] for r in frame.orderBy("at").collect()]
    assert [r["at"] for r in frame.orderBy("at").collect()] == list(range(side**axes))
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(walk, walk[1:]))


def brute_shards(rows, n_shards, bits=hilbert.BITS):
    def codes(values):
        total, seen = len(values), sorted((v for v in values if v is not None))
        nulls = total - len(seen)
        upto = {v: nulls + sum(w <= v for w in seen) for v in set(seen)}
        return [0 if v is None else -(-upto[v] * (1 << bits) // total) - 1 for v in values]

    axes = list(zip(*[codes([r[c] for r in rows]) for c in (2, 3, 4)]))
    digest = [H(*map(field, r)) for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (skilling(axes[i], bits), rows[i][0] is not None, rows[i][0] or 0, digest[i]))
    out = []
    for s in range(n_shards):
        run = order[s * len(rows) // n_shards : (s + 1) * len(rows) // n_shards]
        out += [(s, slot, digest[i]) for slot, i in enumerate(run)]
    return out


@pytest.mark.parametrize("n, n_shards", [(60, 24), (60, 3), (4, 64), (300, 5)])
def test_shards_equal_brute_force(spark, n, n_shards):
    rows = odd_rows(n)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    shards = hilbert.write_shards(docs, n_shards=n_shards)
    found = hilbert.read_shards(shards).collect()
    got = sorted((r["shard"], r["slot"], H(*map(field, (r[c] for c in ("doc_id", "text", "lang", "source", "n_chars"))))) for r in found)
    assert got == sorted(brute_shards(rows, n_shards))
    sizes = collections.Counter(r["shard"] for r in found)
    assert max(sizes.values()) - min([*sizes.values(), *[0] * (len(sizes) < n_shards)]) <= 1


def test_shards_of_an_empty_table_and_clashing_names(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA).selectExpr("*", "1 as shard", "2 as slot", "3 as at", "4 as curve", "5 as digest")
    shards = hilbert.write_shards(docs, n_shards=4)
    found = hilbert.read_shards(shards)
    assert found.columns == [*docs.columns, "shard_", "slot_"]
    assert found.where("shard = 1 and slot = 2 and at = 3 and curve = 4 and digest = 5").count() == docs.count()
    assert hilbert.read_shards(hilbert.write_shards(docs.limit(0), n_shards=4)).count() == 0


def test_shards_prune_in_every_dimension(spark):
    docs = spark.range(8_000).selectExpr("id as doc_id", "'t' as text", "concat('l', pmod(xxhash64(id, 1), 20)) as lang",
                                         "concat('s', pmod(xxhash64(id, 2), 30)) as source", "pmod(xxhash64(id, 3), 5000) as n_chars")
    ranges = hilbert.shard_ranges(hilbert.write_shards(docs, n_shards=64)).collect()
    for column, value in (("lang", "l7"), ("source", "s11"), ("n_chars", 2_500)):
        hit = sum(r[f"min_{column}"] <= value <= r[f"max_{column}"] for r in ranges)
        assert hit <= 32, (column, hit)  # a sort by one column would leave the others at 64


def brute_words(rows, least=6, count=5, ratio=5, one_in=199):
    lower = {c: c + 32 for c in range(65, 91)}
    n = collections.Counter()
    for doc_id, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = word.translate(lower)
            h = zlib.crc32(f"{doc_id}:{word}".encode())
            if doc_id is not None and one_in and h % one_in == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += len(word) >= least
    n = {w: c for w, c in n.items() if c >= count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for w in n:
        best = sorted((-n[x], x) for x in n if near(w, x))
        good = best and -best[0][0] >= ratio * n[w]
        out[w] = (best[0][1] if good else None, n[w], len(best), -best[0][0] if good else None)
    for w in n:
        root = w
        while out[root][0]:
            root = out[root][0]
        yield (w, out[w][0], root, *out[w][1:])


def test_variants_equal_brute_force(spark, monkeypatch):
    """Few letters, so that many words are near, and chunks of a few words each."""
    monkeypatch.setattr(spelling, "CHUNK_WORDS", 7)
    rng = random.Random(5)
    stems = ["".join(rng.choice("abeé") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    rows = []
    for i in range(300):
        words = []
        for _ in range(40):
            w = stems[min(int(rng.expovariate(0.12)), 59)]
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "a", "ba", "é", "Ç"]) + w[at + 1 :]
            words.append(w.capitalize() if rng.random() < 0.2 else w)
        rows.append((rng.choice([i, i, None]), rng.choice([" ", "\n", "1", "中"]).join(words)))
    rows += [(5, None), (6, ""), (None, None), (7, "a" * 70_000), *[(8, "b" * 3_000 + " " + "b" * 3_001)] * 40, (9, "×÷×÷×÷ " * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as word", "2 as n", "3 as key")
    got = sorted(tuple(r) for r in spelling.spelling_variants(docs, least_count=2, ratio=2, one_in=20).collect())
    want = sorted(brute_words(rows, count=2, ratio=2, one_in=20))
    assert got == want and sum(r[1] is not None for r in want) > 20 and any(r[2] != r[1] for r in want if r[1])


def test_long_texts_are_cut_between_words(spark, monkeypatch):
    text = " ".join(f"wörter{'abc'[i % 3]} kurz" for i in range(400))
    docs = spark.createDataFrame([(1, text), (2, "x" * 900 + "\n" + text), (3, "y" * 2_000)], "doc_id long, text string")
    whole = spelling.count_words(docs, least_count=1).collect()
    rows = [(1, text), (2, "x" * 900 + "\n" + text), (3, "y" * 2_000)]
    assert sorted((r.word, r.n) for r in whole) == sorted((w, c) for w, _, _, c, _, _ in brute_words(rows, count=1))
    pieces = list(spelling._pieces(np.array([0, 9, 30]), b"abcdefghi" + b"k" * 21))
    assert pieces == [(0, 2, 0, 30)]
    monkeypatch.setattr(spelling, "PIECE_BYTES", 10)
    cut = list(spelling._pieces(np.array([0, 9, 40]), b"abcdefghi" + b"kkk kkkkkkkkkkkkk\nkkkk kkkkkkkk"))
    assert [c[2:] for c in cut] == [(0, 9), (9, 12), (12, 26), (26, 31), (31, 40)]


def test_words_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(docs).count() == 0


def test_registered_spelling_query(spark):
    db = duckdb.connect()
    rows = db.sql(f"select doc_id, text from '{SMALL}/documents.parquet'").fetchall()
    got = sorted(tuple(r) for r in queries.REGISTRY["op13_spelling_variants"](spark, SMALL).collect())
    assert got == sorted(brute_words(rows)) and got
