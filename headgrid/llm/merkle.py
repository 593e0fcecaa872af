"""Merkle manifest of a table: digest-to-children records and inclusion proofs by descent.

Leaves are grouped and ranked; every ``arity`` consecutive nodes become one, level by level.
The tree is stored as content-addressed records: a record is found by the digest of a node and
holds the nodes below it, level by level, for as many levels as make ``RECORD_CHILDREN`` children.
Equal nodes share a record.

A request names a leaf by its group and rank. All requests descend from the root together: the
digits of a rank choose the child in each record, the children that are not chosen are collected,
and a node that many requests pass is opened once. So the number of joins is that of record levels
(3 for 16 million leaves), the upper ones touch few rows, and no digest is joined by many rows.
The collected path runs from the root down and is reversed for folding.

Ranks come from a range-partitioned sort: no group is gathered, however large. All of it is
DataFrame functions on narrow rows; texts are read once, for their digests.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from headgrid.llm.common import positions, row_digest, stored

ARITY = 2
#: Children of one record at most, 64 bytes each.
RECORD_CHILDREN = 256


@dataclass
class Manifest:
    """``records`` (digest, levels), ``leaves`` (tree, n, rank, digest and the kept columns),
    ``groups`` (tree, group, n), ``subroots`` (tree, n, digest), ``top`` (one row like a subroot, or none)."""

    records: DataFrame
    leaves: DataFrame
    groups: DataFrame
    subroots: DataFrame
    top: DataFrame
    arity: int

    @property
    def stride(self) -> int:
        return stride_of(self.arity)


def stride_of(arity: int) -> int:
    """Levels in one record."""
    if arity < 2:
        raise ValueError("a run has at least two nodes")
    stride = 1
    while arity ** (stride + 1) <= RECORD_CHILDREN:
        stride += 1
    return stride


def _div(value: Column, by: int) -> Column:
    return F.floor(value / F.lit(by)).cast("long") if by > 1 else value


def _joined(nodes: Column) -> Column:
    return F.array_join(nodes, "")


def _runs(nodes: Column, arity: int) -> Column:
    """The level above: the digest of each run of nodes."""
    starts = F.sequence(F.lit(1), F.size(nodes), F.lit(arity))
    return F.transform(starts, lambda at: F.sha2(_joined(F.slice(nodes, at, F.lit(arity))), 256))


def _records(nodes: DataFrame, arity: int) -> tuple[DataFrame | None, DataFrame]:
    """Records and top nodes of trees given by their leaves (tree, n, rank, digest)."""
    stride = stride_of(arity)
    width = arity**stride
    tops = nodes.where("n = 1").select("tree", "n", "digest")
    largest = nodes.agg(F.max("n")).first()[0] or 0
    records, level, span = None, nodes, 1
    while span < largest:
        there = _div(F.col("n") + (span - 1), span)
        height = reduce(lambda a, b: a + b, [(there > arity**i).cast("int") for i in range(stride)])
        pages = (
            level.where(there > 1)
            .groupBy("tree", "n", _div(F.col("rank"), width).alias("rank"))
            .agg(F.array_sort(F.collect_list(F.struct("rank", "digest"))).alias("nodes"))
        )
        children = F.array(F.transform("nodes", lambda x: x["digest"]))
        levels = F.aggregate(
            F.sequence(F.lit(1), height),
            children,
            lambda made, _: F.concat(made, F.array(_runs(F.element_at(made, -1), arity))),
        )
        pages = stored(pages.select("tree", "n", "rank", levels.alias("levels")), "merkle-records")
        level = pages.select("tree", "n", "rank", F.element_at(F.element_at("levels", -1), 1).alias("digest"))
        span *= width
        tops = tops.union(level.where(F.col("n") <= span).select("tree", "n", "digest"))
        found = pages.select(F.element_at(F.element_at("levels", -1), 1).alias("digest"), "levels")
        records = found if records is None else records.union(found)
    return records, tops


def build_manifest(
    docs: DataFrame,
    columns: Sequence[str],
    id_col: str = "doc_id",
    group_col: str = "lang",
    keep: Sequence[str] = (),
    arity: int = ARITY,
) -> Manifest:
    """The tree over all rows of ``docs``, its records stored below the shared folder.

    A leaf is the digest of ``columns`` (each `-` if null, else byte count, `:`, value). Leaves of a
    group ascend by id and give its subroot; the subroots ascend by group and give the root.

    * A null group is a group and comes first; null ids come first in their group.
    * Rows with equal ids ascend by their leaf; rows equal in all ``columns`` have equal leaves and records.
    * Null and empty texts differ. An empty table has no root.
    * Columns that are not named have no effect; any names may clash.
    """
    kept = [F.col(f"`{c}`").alias(f"keep_{i}") for i, c in enumerate(keep)]
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{group_col}`").alias("group"), row_digest(columns).alias("digest"), *kept
    )
    placed = positions(stored(rows, "merkle-leaves"), ["group", "id", "digest"], "place")
    sizes = placed.groupBy("group").agg(F.min("place").alias("start"), F.count("*").alias("n"))
    groups = positions(sizes, ["group"], "tree")
    # The file of groups is as small as the groups are few: Spark broadcasts it by its size.
    groups = stored(groups, "merkle-groups")
    names = groups.withColumnRenamed("group", "of")
    leaves = placed.join(names, F.col("group").eqNullSafe(F.col("of"))).select(
        "tree", "n", (F.col("place") - F.col("start")).alias("rank"), "digest", "id", *[f"keep_{i}" for i in range(len(keep))]
    )
    below, subroots = _records(leaves, arity)
    subroots = stored(subroots, "merkle-subroots")
    n_groups = subroots.count()
    nodes = subroots.select(
        F.lit(0).cast("long").alias("tree"), F.lit(n_groups).cast("long").alias("n"), F.col("tree").alias("rank"), "digest"
    )
    above, top = _records(nodes, arity)
    parts = [r for r in (below, above) if r is not None]
    schema = "digest string, levels array<array<string>>"
    records = reduce(DataFrame.union, parts) if parts else docs.sparkSession.createDataFrame([], schema)
    # Equal digests have equal nodes below them; one record serves all their places.
    records = records.groupBy("digest").agg(F.first("levels").alias("levels"))
    return Manifest(records, leaves, groups.select("tree", "group", "n"), subroots, top, arity)


def _segment(levels: Column, digit: Column, arity: int) -> Column:
    """What is not chosen on the way from a record's node down to child ``digit``, top first."""

    def step(j):
        nodes = F.get(levels, j)
        at = F.floor(digit / F.pow(F.lit(arity), j)).cast("int")
        first = (F.floor(at / F.lit(arity)) * arity).cast("int")
        return F.struct(
            _joined(F.slice(nodes, first + 1, at - first)).alias("before"),
            _joined(F.slice(nodes, at + 2, arity - 1 - (at - first))).alias("after"),
        )

    return F.transform(F.sequence(F.size(levels) - 2, F.lit(0)), step)


def _descend(starts: DataFrame, records: DataFrame, requests: DataFrame, arity: int) -> DataFrame:
    """(tree, item, digest, path) for the requests (tree, rank, item), from the tops of their trees.

    ``starts`` has tree, n, digest and the path so far; paths run from the root down.
    """
    width = arity ** stride_of(arity)
    asked = requests.groupBy("tree", _div(F.col("rank"), width).alias("rank")).agg(
        F.collect_list(F.struct((F.col("rank") % width).cast("int").alias("digit"), "item")).alias("asked")
    )
    asked = stored(asked, "merkle-requests")
    largest = starts.agg(F.max("n")).first()[0] or 0
    spans = [1]
    while spans[-1] * width < largest:
        spans.append(spans[-1] * width)
    front = None
    for span in reversed(spans):
        begin = starts.where((F.col("n") > span) & (F.col("n") <= span * width))
        begin = begin.select("tree", F.lit(0).cast("long").alias("rank"), "digest", "path")
        front = begin if front is None else front.union(begin)
        opened = front.join(records, "digest")
        child = F.get("levels", F.lit(0))
        if span > 1:
            wanted = asked.select("tree", _div(F.col("rank"), span // width).alias("rank")).distinct()
            steps = F.transform(
                F.sequence(F.lit(0), F.size(child) - 1),
                lambda digit: F.struct(
                    (F.col("rank") * width + digit).alias("rank"),
                    F.get(child, digit).alias("digest"),
                    F.concat("path", _segment(F.col("levels"), digit, arity)).alias("path"),
                ),
            )
            below = opened.select("tree", F.inline(steps))
            front = stored(below.join(wanted, ["tree", "rank"], "left_semi"), "merkle-front")
    answers = F.transform(
        "asked",
        lambda x: F.struct(
            x["item"].alias("item"),
            F.get(child, x["digit"]).alias("digest"),
            F.concat("path", _segment(F.col("levels"), x["digit"], arity)).alias("path"),
        ),
    )
    deep = opened.drop("digest").join(asked, ["tree", "rank"]).select("tree", F.inline(answers))
    lone = starts.where("n = 1").join(asked, "tree").select("tree", F.explode("asked").alias("x"), "digest", "path")
    return deep.union(lone.select("tree", "x.item", "digest", "path"))


def prove(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """One row for each requested leaf: id, the kept columns, leaf, subroot, root, path.

    ``requests`` are rows of ``manifest.leaves``, all of them if None. ``path`` has the unselected
    children of each run from the leaf to the root, those before and those after the own node, as
    concatenated digests; a run of one has none.
    """
    wanted = manifest.leaves if requests is None else requests
    tops = manifest.top.first()
    if tops is None:
        none = wanted.withColumns({c: F.lit(None).cast("string") for c in ("leaf", "subroot", "root")})
        path = F.lit(None).cast("array<struct<before:string,after:string>>")
        return none.drop("tree", "n", "rank", "digest").withColumn("path", path).limit(0)
    empty = F.array().cast("array<struct<before:string,after:string>>")
    groups = manifest.groups.select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"), F.struct("tree", "n").alias("item")
    )
    reached = _descend(manifest.top.withColumn("path", empty), manifest.records, groups, manifest.arity)
    starts = stored(reached.select("item.tree", "item.n", "digest", "path"), "merkle-starts")
    names = [c for c in wanted.columns if c not in ("tree", "n", "rank", "digest")]
    asked = wanted.select("tree", "rank", F.struct(*names).alias("item"))
    found = _descend(starts, manifest.records, asked, manifest.arity)
    subroots = starts.select("tree", F.col("digest").alias("subroot"))
    return found.join(subroots, "tree").select(
        "item.*", F.col("digest").alias("leaf"), "subroot", F.lit(tops.digest).alias("root"), F.reverse("path").alias("path")
    )


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda node, run: F.sha2(F.concat(run["before"], node, run["after"]), 256))


def path_digest(path: Column) -> Column:
    """Digest of all siblings on a path, from the leaf to the root."""
    return F.sha2(F.array_join(F.transform(path, lambda run: F.concat(run["before"], run["after"])), ""), 256)
