"""Walks over the cost-centre tree and over the chain of versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from headgrid.session import cut


def _walk(nodes: DataFrame, anchors: DataFrame) -> DataFrame:
    """All active nodes reachable from the anchors, one level per round.

    Each round joins the last level with its children and is cut from its lineage,
    so the work over all rounds is one pass over the result, and the number of rounds
    is the depth of the tree. An inactive node ends its branch. A node already on
    the path is not entered again, so a cycle ends too.
    """
    active = nodes.where("is_active").select("id", "code", "name", "level", "parent_id")
    level = cut(anchors)
    found = level
    while not level.isEmpty():
        children = active.alias("c").join(level.alias("p"), F.col("c.parent_id") == F.col("p.id"))
        level = cut(
            children.where(~F.array_contains("p.path_ids", F.col("c.id"))).select(
                "p.root_id",
                "c.*",
                F.concat("p.path_ids", F.array("c.id")).alias("path_ids"),
                F.concat("p.path_names", F.array("c.name")).alias("path_names"),
                (F.col("p.depth") + 1).alias("depth"),
            )
        )
        found = found.unionByName(level)
    return found


def _anchors(nodes: DataFrame) -> DataFrame:
    return nodes.where("is_active").select(
        F.col("id").alias("root_id"),
        "id",
        "code",
        "name",
        "level",
        "parent_id",
        F.array("id").alias("path_ids"),
        F.array("name").alias("path_names"),
        F.lit(0).alias("depth"),
    )


def hierarchy_tree(costcenters: DataFrame, ordered: bool = True) -> DataFrame:
    """The active tree with the path from the root to each node, parents before children."""
    roots = _anchors(costcenters.where(F.col("parent_id").isNull()))
    tree = _walk(costcenters, roots).drop("root_id")
    return tree.orderBy("path_names") if ordered else tree


def hierarchy_descendants(costcenters: DataFrame, roots: DataFrame, ordered: bool = True) -> DataFrame:
    """Active nodes below each ``root_id``, the root included.

    An inactive root has none. Whether the root's own ancestors are active is not
    looked at.
    """
    wanted = roots.select("root_id").distinct()
    anchors = _anchors(costcenters.join(wanted, costcenters["id"] == wanted["root_id"], "left_semi"))
    below = _walk(costcenters, anchors).select("root_id", "id", "code", "name", "level", "parent_id")
    return below.orderBy("root_id", "level", "code") if ordered else below


def hierarchy_problems(costcenters: DataFrame) -> DataFrame:
    """``(id, reason)`` of the active nodes that the tree does not reach.

    The first obstacle on the way up decides: ``missing_parent``, ``inactive_ancestor``, or
    ``cycle`` for nodes on or below a ring. All nodes climb at once and double their step each
    round. As long as a node below no ring is under way, some node arrives in every round; what
    is left when none does is below a ring.
    """
    nodes = costcenters.select("id", "parent_id", "is_active")
    parents = nodes.select(F.col("id").alias("up"), F.col("is_active").alias("up_active"))
    first = nodes.where("is_active").join(parents, F.col("parent_id") == F.col("up"), "left")
    seen = (
        F.when(F.col("parent_id").isNull(), "root")
        .when(F.col("up").isNull(), "missing_parent")
        .when(~F.col("up_active"), "inactive_ancestor")
    )
    ways = cut(first.select("id", F.when(seen.isNull(), F.col("parent_id")).alias("at"), seen.alias("reason")))
    under_way, last = ways.where("reason is null").count(), -1
    while under_way not in (0, last):
        ahead = ways.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("reason").alias("found"))
        done, moving = ways.where("reason is not null"), ways.where("reason is null")
        moved = moving.join(ahead, "at").select("id", F.col("next").alias("at"), F.col("found").alias("reason"))
        ways = cut(done.unionByName(moved))
        under_way, last = ways.where("reason is null").count(), under_way
    reason = F.coalesce("reason", F.lit("cycle"))
    return ways.select("id", reason.alias("reason")).where("reason <> 'root'")


def version_chain(links: DataFrame, starts: DataFrame, id_col: str = "id", source_col: str = "source_version_id") -> DataFrame:
    """``(start_id, id, position)`` along the source links, position 1 = the start.

    ``starts`` has a column ``start_id``. The links are doubled each round (2, 4, 8
    steps at a time), so a chain of n links needs about log2(n) joins, and a
    single very long chain is spread over all tasks like any other rows. Each round is kept
    once and looked at once: an id that a start meets again is a cycle and raises
    ``ValueError``, and the walk ends when no start gets further. Cycles that no start
    leads to do no harm.
    """
    known = links.select(F.col(id_col).alias("id"))
    first = starts.select(F.col("start_id").alias("from")).distinct()
    first = first.join(known, first["from"] == known["id"], "left_semi")
    jumps = links.select(F.col(id_col).alias("from"), F.col(source_col).alias("to")).where(F.col("to").isNotNull())
    jumps = jumps.join(known, jumps["to"] == known["id"], "left_semi")
    # Rows with a position have been reached, those without are jumps of `steps` links.
    none = F.lit(None).cast("long")
    state = cut(
        first.select("from", F.col("from").alias("to"), F.lit(1).cast("long").alias("position")).unionByName(
            jumps.select("from", "to", none.alias("position"))
        )
    )
    steps = 1
    while True:
        reached, jump = state.where("position is not null"), state.where("position is null")
        onward = jump.select(F.col("from").alias("to"), F.col("to").alias("next"))
        ahead = reached.join(onward, "to").select("from", F.col("next").alias("to"), (F.col("position") + steps).alias("position"))
        further = jump.drop("position").join(onward, "to").select("from", F.col("next").alias("to"), none.alias("position"))
        state = cut(reached.unionByName(ahead).unionByName(further))
        steps *= 2
        met = state.where("position is not null").groupBy("from", "to").agg(F.count("*").alias("times"), F.max("position").alias("position"))
        seen = met.agg(F.max("times").alias("times"), F.max("position").alias("furthest")).first()
        if (seen.times or 0) > 1:
            raise ValueError("the version links contain a cycle")
        if (seen.furthest or 0) <= steps // 2:
            return state.where("position is not null").select(F.col("from").alias("start_id"), F.col("to").alias("id"), "position")


def version_chain_rows(versions: DataFrame, start: str) -> DataFrame:
    """Registry rows of the chain that begins at ``start``, newest first."""
    first = versions.where(F.col("id") == start).select(F.col("id").alias("start_id"))
    chain = version_chain(versions, first).drop("start_id")
    return versions.join(chain, "id").orderBy("position")
