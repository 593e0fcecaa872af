"""One query for each operator, over whole tables with production parameters, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from headgrid.llm import bpe, exact_dedup, hilbert, html_extract, langid, merkle, mixing, quality_rank, quality_rules, simhash, spelling, token_files, toxicity
from headgrid.llm.common import scratch

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

MULTI_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Target share of words of each domain, and words in the mix for each word of the input.
TARGETS = {"clean": 0.9, "poor": 0.07, "toxic": 0.03}
BUDGET = 1.25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


@query
def op1_simhash(spark, sf_dir):
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op2_language_id(spark, sf_dir):
    return langid.language_id(table(spark, sf_dir, "documents"))


@query
def op3_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), quality_rules.CORPUS_BANDS)


@query
def op4_html_extract(spark, sf_dir):
    found = html_extract.extract_text(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query
def op5_bpe(spark, sf_dir):
    both = bpe.bpe_round_trip(table(spark, sf_dir, "documents"), MULTI_RANKS, public_tokenizers.PATTERN)
    return both.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


@query
def op6_mixing(spark, sf_dir):
    labelled = mixing.label_domains(table(spark, sf_dir, "labels"))
    return mixing.mixing_rates(table(spark, sf_dir, "documents"), labelled, TARGETS, BUDGET, keep=("source",))[0]


@query
def op7_token_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    manifest = token_files.write_token_files(docs, scratch(docs, "token-files"), BYTE_VOCABULARY, public_tokenizers.PATTERN)
    found = token_files.read_token_files(manifest)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op8_exact_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    return exact_dedup.exact_groups(docs, keep=("text_sha256",)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE["op8_exact_dedup"] = """
SELECT doc_id,
       first(doc_id) OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


@query
def op9_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_quality_rank(spark, sf_dir):
    return quality_rank.quality_rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    claim = merkle.row_digest(["doc_id", "source", "lang", F.col("n_chars") + 1, "text"])
    docs = docs.withColumn("claim", F.when(tampered, claim))
    manifest = merkle.build_manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], keep=("claim",))
    found = merkle.prove(manifest)
    folded = merkle.fold(F.coalesce("keep_0", "leaf"), F.col("path"))
    found = found.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.path_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root")
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


#: One row: the values of CRC-32 for each byte, by its polynomial.
CRC_TABLE = """crc_table AS (
  SELECT list(value ORDER BY byte) AS crc_values FROM (
    SELECT i AS byte, list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS value
    FROM (SELECT unnest(range(0, 256))::bigint AS i) b) v)"""


def _crc_sql(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes, beside ``crc_table``."""
    steps = f"list_transform(regexp_extract_all(hex({text}), '..'), lambda h: ('0x' || h)::bigint)"
    start = f"list_prepend(4294967295::bigint, {steps})"
    return f"xor(list_reduce({start}, lambda c, x: xor(crc_values[xor(c & 255, x) + 1], c >> 8)), 4294967295)"


ORACLE["op11_merkle_manifest"] = """
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS rank,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
         concat(coalesce(strlen(doc_id::varchar) || ':' || doc_id::varchar, '-'), coalesce(strlen(source) || ':' || source, '-'),
                coalesce(strlen(lang) || ':' || lang, '-')) AS head,
         coalesce(strlen(n_chars::varchar) || ':' || n_chars::varchar, '-') AS size,
         coalesce(strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1)::varchar, '-') AS other_size,
         coalesce(strlen(text) || ':' || text, '-') AS body
  FROM documents),
hashed AS (SELECT doc_id, tree, rank, sha256(head || size || body) AS leaf, sha256(head || other_size || body) AS other FROM leaves),
lower_nodes AS (
  SELECT tree, 0 AS level, rank, leaf AS digest FROM hashed
  UNION ALL
  SELECT tree, level + 1, rank // 2, sha256(string_agg(digest, '' ORDER BY rank))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS here FROM lower_nodes) x WHERE here > 1 GROUP BY tree, level, rank // 2),
subroots AS (SELECT tree, arg_max(digest, level) AS subroot, max(level) AS height FROM lower_nodes GROUP BY tree),
upper_nodes AS (
  SELECT 0 AS level, tree AS rank, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, rank // 2, sha256(string_agg(digest, '' ORDER BY rank))
  FROM (SELECT *, count(*) OVER () AS here FROM upper_nodes) x WHERE here > 1 GROUP BY level, rank // 2),
top AS (SELECT arg_max(digest, level) AS root, max(level) AS height FROM upper_nodes),
ways AS (
  SELECT h.tree, h.rank, s.level AS spot, s.level, h.rank // (1 << s.level) AS place, false AS upper
  FROM hashed h JOIN subroots r USING (tree) JOIN (SELECT DISTINCT level FROM lower_nodes) s ON s.level < r.height
  UNION ALL
  SELECT h.tree, h.rank, 1000 + s.level, s.level, h.tree // (1 << s.level), true
  FROM hashed h CROSS JOIN top t JOIN (SELECT DISTINCT level FROM upper_nodes) s ON s.level < t.height),
siblings AS (
  SELECT w.tree, w.rank, w.spot, w.place % 2 = 1 AS is_left, coalesce(l.digest, u.digest, '') AS digest
  FROM ways w
  LEFT JOIN lower_nodes l ON NOT w.upper AND l.tree = w.tree AND l.level = w.level AND l.rank = xor(w.place, 1)
  LEFT JOIN upper_nodes u ON w.upper AND u.level = w.level AND u.rank = xor(w.place, 1)),
steps AS (
  SELECT *, row_number() OVER (PARTITION BY tree, rank ORDER BY spot) AS step FROM siblings),
proofs AS (SELECT tree, rank, sha256(string_agg(digest, '' ORDER BY step)) AS proof, max(step) AS n FROM steps GROUP BY tree, rank),
""" + CRC_TABLE + """,
marked AS (SELECT doc_id FROM documents CROSS JOIN crc_table WHERE """ + _crc_sql("doc_id::varchar") + """ % 7 = 0),
folded AS (
  SELECT tree, rank, 0 AS step, CASE WHEN doc_id IN (SELECT doc_id FROM marked) THEN other ELSE leaf END AS node FROM hashed
  UNION ALL
  SELECT f.tree, f.rank, f.step + 1, sha256(CASE WHEN s.is_left THEN s.digest || f.node ELSE f.node || s.digest END)
  FROM folded f JOIN steps s ON s.tree = f.tree AND s.rank = f.rank AND s.step = f.step + 1)
SELECT h.doc_id, h.leaf, r.subroot, t.root, coalesce(p.proof, sha256('')) AS proof_sha256, f.node AS folded_root, f.node = t.root AS verified
FROM hashed h JOIN subroots r USING (tree) CROSS JOIN top t LEFT JOIN proofs p ON p.tree = h.tree AND p.rank = h.rank
JOIN folded f ON f.tree = h.tree AND f.rank = h.rank AND f.step = coalesce(p.n, 0)
"""


@query
def op12_hilbert_shards(spark, sf_dir):
    shards = hilbert.write_shards(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return hilbert.read_shards(shards).select(
        "doc_id",
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _hilbert_sql() -> str:
    """Codes by cumulative counts, then one select for each turn of the curve."""
    steps, number = [], 0
    for b in range(hilbert.BITS - 1, 0, -1):
        low = (1 << b) - 1
        for axis in range(3):
            own, low_xor = f"x{axis}", f"xor(x0, x{axis}) & {low}"
            first = f"CASE WHEN {own} & {1 << b} <> 0 THEN xor(x0, {low}) ELSE xor(x0, {low_xor}) END"
            other = f"CASE WHEN {own} & {1 << b} <> 0 THEN {own} ELSE xor({own}, {low_xor}) END"
            axes = [first if i == 0 else other if i == axis else f"x{i}" for i in range(3)]
            steps.append(f"s{number + 1} AS (SELECT doc_id, {', '.join(f'{a} AS x{i}' for i, a in enumerate(axes))} FROM s{number})")
            number += 1
    gray = ["x0", "xor(x0, x1)", "xor(xor(x0, x1), x2)"]
    bits = [f"({gray[axis]} >> {b} & 1) AS b{b}_{axis}" for b in range(hilbert.BITS) for axis in range(3)]
    terms, weight = [], 3 * hilbert.BITS
    for b in range(hilbert.BITS - 1, -1, -1):
        turned = " + ".join(f"b{h}_2" for h in range(b + 1, hilbert.BITS)) or "0"
        for axis in range(3):
            weight -= 1
            terms.append(f"((b{b}_{axis} + {turned}) % 2) * {1 << weight}")
    upto, total = "(count(*) OVER (ORDER BY {c} NULLS FIRST))", "(count(*) OVER ())"
    code = f"CAST(({upto} * 64 + {total} - 1) // {total} - 1 AS BIGINT)"
    codes = ", ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {code.format(c=c)} END AS x{i}" for i, c in enumerate(hilbert.DIMENSIONS))
    return f"""
WITH {CRC_TABLE},
s0 AS (SELECT doc_id, {codes} FROM documents),
{", ".join(steps)},
bits AS (SELECT doc_id, {", ".join(bits)} FROM s{number}),
curve AS (SELECT doc_id, {" + ".join(terms)} AS place FROM bits),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY place, doc_id NULLS FIRST) - 1 AS at_row, count(*) OVER () AS n FROM curve),
sharded AS (SELECT doc_id, at_row, n, (24 * (at_row + 1) + n - 1) // n - 1 AS shard FROM placed)
SELECT d.doc_id, cast(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size, {_crc_sql("coalesce(text, '')")} AS text_crc32, 'rows' AS law,
  cast(shard AS INTEGER) AS shard, at_row - (shard * n) // 24 AS slot, cast(NULL AS INTEGER) AS grown_shard
FROM sharded JOIN documents d USING (doc_id) CROSS JOIN crc_table"""


ORACLE["op12_hilbert_shards"] = _hilbert_sql()


@query
def op13_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


ORACLE["op13_spelling_variants"] = f"""
WITH RECURSIVE {CRC_TABLE},
texts AS (
  SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents WHERE text IS NOT NULL),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[a-zÀ-ÿ]+')) AS run FROM texts),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run),
hashed AS (SELECT run, n, {_crc_sql("doc_id::varchar || ':' || run")} AS h FROM counted CROSS JOIN crc_table),
cut AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, cast(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
holes AS (
  SELECT word, at_letter, substr(word, 1, at_letter - 1) || substr(word, at_letter + 1) AS rest
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS at_letter FROM words) p),
pairs AS (
  SELECT a.word, b.word AS other FROM holes a JOIN holes b ON a.at_letter = b.at_letter AND a.rest = b.rest AND a.word <> b.word
  UNION
  SELECT a.word, w.word FROM holes a JOIN words w ON w.word = a.rest
  UNION
  SELECT w.word, a.word FROM holes a JOIN words w ON w.word = a.rest),
ranked AS (
  SELECT p.word, p.other, o.n, row_number() OVER (PARTITION BY p.word ORDER BY o.n DESC, p.other) AS nth, count(*) OVER (PARTITION BY p.word) AS n_near
  FROM pairs p JOIN words o ON o.word = p.other),
forms AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= 5 * w.n THEN r.other END AS form, CASE WHEN r.n >= 5 * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.nth = 1),
ways AS (
  SELECT word, coalesce(form, word) AS at_word, form IS NULL AS done FROM forms
  UNION ALL
  SELECT y.word, coalesce(f.form, y.at_word), f.form IS NULL FROM ways y JOIN forms f ON f.word = y.at_word WHERE NOT y.done)
SELECT f.word, f.form, y.at_word AS root, f.n, f.n_near, f.form_n FROM forms f JOIN ways y ON y.word = f.word AND y.done
"""
