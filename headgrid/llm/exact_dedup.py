"""Exact duplicates by progressive refinement: length, prefix hash, full hash.

Lengths are counted first. Prefixes are hashed only of texts whose length is shared, and counted by length
and prefix. Full texts are hashed only where both are shared. Between the steps nothing but a bit
map of the shared keys is sent to the executors, so no text is shuffled; its size follows from their
number, within a bound. A false hit costs a needless hash and never changes a result. Groups of equal length
and SHA-256 are equal texts. Hot groups are counted by partial aggregation; no group is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from headgrid.llm.common import fresh, stored

PREFIX_CHARS = 256
#: Bits of a map for each shared key, and the largest map: 2^28 bits are 8,192 rows of 4 KB, 32 MB in all. Beyond 2^27
#: keys a full map lets most texts through to the next hash, which costs less than a join that shuffles texts.
BITS_PER_KEY = 16
MAX_BITS = 1 << 28
#: Bits in one value of bitmap_construct_agg.
PART_BITS = 32_768


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def _length(text_col: str) -> Column:
    return F.octet_length(_text(text_col))


def _prefix(text_col: str, prefix_chars: int) -> Column:
    return F.xxhash64(F.substring(_text(text_col), 1, prefix_chars))


def map_bits(n_keys: int) -> int:
    """Size of the map for so many keys: a power of two with BITS_PER_KEY or more for each, within MAX_BITS."""
    return min(MAX_BITS, max(PART_BITS, 1 << (BITS_PER_KEY * max(n_keys, 1) - 1).bit_length()))


def _mark(rows: DataFrame, key: list[Column], keys: DataFrame, flag: str, where: Column | None = None) -> DataFrame:
    """``rows`` and ``flag``: whether ``key`` may be among the rows of ``keys``, False if it is not; looked up only ``where``."""
    bits = map_bits(keys.count())
    slot = F.pmod(F.xxhash64(*keys.columns), F.lit(bits))
    parts = keys.select(slot.alias("slot")).groupBy(F.floor(F.col("slot") / PART_BITS).alias("part"))
    slot_of, part, held = (fresh(rows, n) for n in ("slot_of", "part_of", "bits_of"))
    bit_map = parts.agg(F.bitmap_construct_agg(F.col("slot") % PART_BITS)).toDF(part, held)
    own = F.pmod(F.xxhash64(*key), F.lit(bits))
    found = rows.withColumn(slot_of, own if where is None else F.when(where, own))
    found = found.join(F.broadcast(bit_map), F.floor(F.col(slot_of) / PART_BITS) == F.col(part), "left")
    at = F.col(slot_of) % PART_BITS
    byte = F.conv(F.hex(F.substr(F.col(held), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], hit.alias(flag))


def shared_lengths(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Lengths that two or more texts have."""
    return docs.groupBy(_length(text_col).alias("length")).agg(F.count("*").alias("n")).where("n > 1").select("length")


def mark_shared_lengths(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` and a boolean column, whose name is returned: False where no other text has the length."""
    flag = fresh(docs, "shared_length")
    return _mark(docs, [_length(text_col)], stored(shared_lengths(docs, text_col), "lengths"), flag), flag


def mark_candidates(docs: DataFrame, text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> tuple[DataFrame, str]:
    """``docs`` and a boolean column, whose name is returned: False where no other text can be equal.

    Only texts with a shared length have their prefix hashed, both for the counts and for the mark.
    """
    rows, length_shared = mark_shared_lengths(docs, text_col)
    key = [_length(text_col), _prefix(text_col, prefix_chars)]
    counts = rows.where(length_shared).groupBy(key[0].alias("length"), key[1].alias("prefix")).agg(F.count("*").alias("n"))
    shared = stored(counts.where("n > 1").select("length", "prefix"), "prefixes")
    flag = fresh(rows, "candidate")
    return _mark(rows, key, shared, flag, F.col(length_shared)).drop(length_shared), flag


def _tie(docs: DataFrame, id_col: str, text_col: str) -> Column:
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    return F.xxhash64(F.to_json(F.struct(*rest))) if rest else F.lit(0).cast("long")


def _best() -> Column:
    """Largest id, then largest tie; null ids come last."""
    return F.max(F.struct(F.col("id").isNotNull(), F.col("id"), F.col("tie")))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
    prefix_chars: int = PREFIX_CHARS,
) -> DataFrame:
    """One row per row of ``docs``: id_col, ``keep``, keep_id, group_size, kept.

    Of equal texts the row with the largest id stays.

    * A null text is the empty text; empty texts are equal to each other.
    * A null id is smaller than any other. Rows equal in text and id are ties: the one with the
      largest hash of its other columns stays, and one of rows that are equal throughout.
    * An empty table gives an empty result; other columns only break ties. ``keep`` may not
      name keep_id, group_size or kept.
    """
    marked, flag = mark_candidates(docs, text_col, prefix_chars)
    text = _text(text_col)
    kept_columns = [F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)]
    names = [f"keep_{i}" for i in range(len(keep))]
    single = marked.where(~F.col(flag)).select(
        F.col(id_col).alias("id"), *kept_columns, F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")
    )
    rows = marked.where(flag).select(
        F.col(id_col).alias("id"),
        *kept_columns,
        _tie(docs, id_col, text_col).alias("tie"),
        F.octet_length(text).alias("length"),
        F.sha2(text, 256).alias("full"),
    )
    same = stored(rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")), "candidates")
    groups = stored(same.groupBy("length", "full").agg(_best().alias("best"), F.sum("copies").alias("group_size")), "groups")
    found = same.join(groups, ["length", "full"])
    won = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("tie") == F.col("best.tie"))
    grouped = found.select(
        "id", *names, F.col("best.id").alias("keep_id"), "group_size", won.alias("won"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
    ).select("id", *names, "keep_id", "group_size", (F.col("won") & (F.col("copy") == 1)).alias("kept"))
    return single.union(grouped).toDF(id_col, *keep, "keep_id", "group_size", "kept")


def drop_exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS
) -> DataFrame:
    """The rows of ``docs`` that stay, as in ``exact_groups``, with all columns.

    Texts without a shared length and prefix hash pass without a shuffle.
    """
    marked, flag = mark_candidates(docs, text_col, prefix_chars)
    who, tie, length, full = (fresh(marked, n) for n in ("row_id", "tie_key", "text_length", "full_hash"))
    text = _text(text_col)
    rows = marked.where(flag).drop(flag).withColumns(
        {
            who: F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit("n")),
            tie: _tie(docs, id_col, text_col),
            length: F.octet_length(text),
            full: F.sha2(text, 256),
        }
    )
    narrow = rows.select(F.col(id_col).alias("id"), F.col(who).alias("who"), F.col(tie).alias("tie"), F.col(length).alias("length"), F.col(full).alias("full"))
    best = F.max(F.struct(F.col("id").isNotNull(), F.col("id"), F.col("tie"), F.col("who"))).alias("best")
    winners = narrow.groupBy("length", "full").agg(best).select(
        F.col("best.who").alias(who), F.col("best.tie").alias(tie), F.col("length").alias(length), F.col("full").alias(full)
    )
    keys = [who, tie, length, full]
    stay = rows.join(stored(winners, "winners"), keys, "left_semi").dropDuplicates(keys)
    return marked.where(~F.col(flag)).select(*docs.columns).union(stay.select(*docs.columns))
