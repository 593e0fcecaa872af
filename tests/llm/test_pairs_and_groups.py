"""SimHash and exact duplicates against brute force, and their edge cases."""

import hashlib
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from headgrid.llm import exact_dedup, simhash

SCHEMA = "doc_id long, text string, lang string, component_id string"
EDGE = [(1, None, "a", "x"), (2, "", "a", "x"), (3, " \n", None, None), (None, "", "b", "y"), (4, "one two", "a", None), (4, "one two", "a", None), (5, "w " * 30_000, "a", "z")]


def slow_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    found = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in found]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(prints, bits):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= bits:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def test_golay_code_is_perfect():
    words = np.random.default_rng(1).integers(0, 1 << 23, 4000)
    low, high, errors = simhash._tables()
    assert len(set(errors.tolist())) == 2048 and max(bin(e).count("1") for e in errors.tolist()) == 3
    keys, first = simhash.golay_keys(words)
    assert set(first.sum(axis=1).tolist()) <= {1, 6}


def test_every_pair_within_four_bits_shares_a_bucket():
    draw = random.Random(2)
    for _ in range(400):
        a = draw.getrandbits(64)
        b = a
        for bit in draw.sample(range(64), 4):
            b ^= 1 << bit
        keys, rows = simhash.bucket_keys(np.array([a, b], dtype="<u8").view("<i8"))
        assert set(keys[rows == 0].tolist()) & set(keys[rows == 1].tolist())


def test_fingerprints_equal_the_definition():
    draw = random.Random(3)
    texts = [None, "", "  ", "One", "ONE two Three", "É a b c\x0bd"] + [" ".join(draw.choices(["ab", "Cd", "éf", "x\ny"], k=draw.randint(1, 60))) for _ in range(60)]
    assert [simhash.fingerprint(t) for t in texts] == [slow_print(t) for t in texts]


def planted(n_groups=12, size=25):
    draw = random.Random(4)
    rows = []
    for g in range(n_groups):
        words = [f"w{draw.randint(0, 500)}" for _ in range(400)]
        for _ in range(size):
            words = words.copy()
            words[draw.randrange(400)] = f"v{draw.randint(0, 9999)}"
            rows.append(" ".join(words))
    draw.shuffle(rows)
    return rows


def test_components_equal_brute_force(spark):
    texts = planted()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    want = roots([slow_print(t) for t in texts], 4)
    got = {r["doc_id"]: r["component_id"] for r in simhash.simhash_components(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert len(set(want)) < len(texts) / 2


def test_large_buckets_in_blocks_give_the_same_components(spark):
    draw = random.Random(5)
    prints = [draw.getrandbits(64)]
    for _ in range(300):
        prints.append(draw.choice(prints) ^ sum(1 << b for b in draw.sample(range(64), draw.randint(1, 5))))
    prints = sorted(set(prints))
    rows = spark.createDataFrame([(int(np.array([p], "<u8").view("<i8")[0]),) for p in prints], "fingerprint long")
    found = []
    for block in (20_000, 5):
        stars = simhash.connected(simhash.fingerprint_links(rows, 4, block)).collect()
        found.append({(r["node"], r["root"]) for r in stars})
    assert found[0] == found[1]
    root = {n % (1 << 64): r % (1 << 64) for n, r in found[0]}
    want = roots(prints, 4)
    groups = {}
    for p, w in zip(prints, want):
        groups.setdefault(w, set()).add(root.get(p, p))
    assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)


def test_simhash_edge_cases(spark):
    docs = spark.createDataFrame(EDGE, SCHEMA)
    rows = simhash.simhash_components(docs).collect()
    assert len(rows) == len(EDGE)
    assert {r["component_id"] for r in rows if r["fingerprint"] == 0} == {1}
    assert simhash.simhash_components(docs.limit(0)).collect() == []
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5]
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_simhash_stage_keeps_one_of_each_group(spark):
    texts = planted(5, 8)
    docs = spark.createDataFrame([(i, t, "en", i) for i, t in enumerate(texts)], "doc_id long, text string, lang string, root long")
    got = sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect())
    assert got == sorted(set(roots([slow_print(t) for t in texts], 4)))


def test_exact_groups_equal_brute_force(spark):
    draw = random.Random(6)
    rows = [(i, draw.choice(["", None, "a", "b", "x" * 300 + "1", "x" * 300 + "2", "é", f"only {i}"])) for i in range(400)]
    rows += [(7, "x" * 300 + "1"), (7, "x" * 300 + "1"), (None, "a"), (None, "never else")]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, keep_id string").repartition(5)
    got = exact_dedup.exact_groups(docs.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256)), keep=("sha",)).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(hashlib.sha256((t or "").encode()).hexdigest(), []).append(i)
    want = []
    for sha, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = max(known) if known else None
        free = True
        for i in ids:
            stays = free and i == best
            free = free and not stays
            want.append((i, sha, best, len(ids), stays))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_exact_stage_and_edges(spark):
    docs = spark.createDataFrame(EDGE, SCHEMA)
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], (r["text"] or "")[:7]) for r in kept.collect()) == [(2, ""), (3, " \n"), (4, "one two"), (5, "w w w w")]
    assert exact_dedup.exact_groups(docs.limit(0)).collect() == []
    assert exact_dedup.drop_exact_duplicates(docs.limit(0)).collect() == []


def test_full_texts_are_hashed_for_candidates_only(spark):
    docs = spark.createDataFrame([(1, "same"), (2, "same"), (3, "other"), (4, "longer text")], "doc_id long, text string")
    marked, flag = exact_dedup.mark_candidates(docs)
    assert {r["doc_id"]: r[flag] for r in marked.collect()} == {1: True, 2: True, 3: False, 4: False}


def test_each_step_hashes_only_what_the_step_before_leaves(spark):
    tail = ["a", "a", "b"]  # equal in length and prefix, the last one different
    texts = ["alone and longest" * 40, *["p" * 300 + t for t in tail], *["q" * 300 + "a"], "four", "five", "seven"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marked, flag = exact_dedup.mark_shared_lengths(docs)
    prefix_hashed = {r["doc_id"] for r in marked.collect() if r[flag]}
    marked, flag = exact_dedup.mark_candidates(docs)
    full_hashed = {r["doc_id"] for r in marked.collect() if r[flag]}
    assert prefix_hashed == {1, 2, 3, 4, 5, 6} and full_hashed == {1, 2, 3}
    groups = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(docs).collect()}
    assert groups == {i: (i, 1, True) for i in range(8)} | {1: (2, 2, False), 2: (2, 2, True)}
    # the prefix of a text is hashed only where its length is shared
    text = marked._jdf.queryExecution().optimizedPlan().toString()
    guarded = re.findall(r"THEN pmod\(xxhash64\(octet_length\([^)]*\)\), xxhash64\(substring\(", text)
    assert len(guarded) == text.count("substring(") == 1, text


def test_maps_follow_the_number_of_keys():
    sizes = [exact_dedup.map_bits(n) for n in (0, 1, 2048, 2049, 10**6, 10**12)]
    assert sizes == [32768, 32768, 32768, 65536, 1 << 24, exact_dedup.MAX_BITS]
