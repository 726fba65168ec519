"""Hierarchies of presentation and calculation arcs.

Arcs form many small trees (one for each filing and role). Traversal goes level by level over all trees at once: each
level is one equi-join on (filing_id, role, concept) and is written, until no tree has a further level.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.operators.lineage import Levels, cut

TREE = ("filing_id", "role")


def roots(arcs: DataFrame) -> DataFrame:
    """Parents that are nobody's child, by tree."""
    parents = arcs.groupBy(*TREE, F.col("parent").alias("concept")).agg(F.min("arc_seq").alias("arc_seq"))
    return parents.join(arcs.select(*TREE, F.col("child").alias("concept")).distinct(), [*TREE, "concept"], "left_anti")


def last_arcs(arcs: DataFrame) -> DataFrame:
    """Of arcs that share tree, parent and child, the last one. A missing or unreadable order counts as 0."""
    order = F.coalesce(F.try_to_number("order", F.lit("999999999.999")), F.lit(0)).cast("double") if dict(arcs.dtypes)["order"] == "string" else F.coalesce("order", F.lit(0.0)).cast("double")
    return arcs.withColumn("order", order).groupBy(*TREE, "parent", "child").agg(*[F.max_by(c, "arc_seq").alias(c) for c in ("order", "weight")], F.max("arc_seq").alias("arc_seq"))


def _start(down: DataFrame) -> DataFrame:
    """The roots as the first level of a walk."""
    return roots(down).select(
        *TREE, "concept", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("level"), F.array("concept").alias("path"),
        F.array(F.struct(F.lit(0.0).alias("order"), F.col("arc_seq").cast("long").alias("seq"))).alias("sort_key"), F.lit(1.0).alias("weight"),
    )


def _below(level: DataFrame, down: DataFrame, k: int) -> DataFrame:
    """One step down from all places of a level."""
    step = F.struct(F.col("order").cast("double").alias("order"), F.col("arc_seq").cast("long").alias("seq"))
    arcs_from = down.select(*TREE, F.col("parent").alias("concept"), "child", step.alias("step"), F.col("weight").alias("w"))
    return level.join(arcs_from, [*TREE, "concept"]).filter(~F.array_contains("path", F.col("child"))).select(
        *TREE, F.col("child").alias("concept"), F.col("concept").alias("parent"), F.lit(k).alias("level"), F.concat("path", F.array("child")).alias("path"),
        F.concat("sort_key", F.array("step")).alias("sort_key"), (F.col("weight") * F.coalesce("w", F.lit(1.0))).alias("weight"),
    )


def walk(arcs: DataFrame, max_levels: int | None = None) -> DataFrame:
    """All paths from roots down: tree, concept, parent, level, path (concepts), sort_key, weight (product of weights).

    A path ends where it would meet a concept a second time, or after max_levels levels if they are given. sort_key orders a tree in pre-order: siblings by order,
    then by place in the input. A tree whose arcs form a mere cycle has no root and no path. Concepts with several
    parents are there once for each path; first_places gives each once, at a cost that does not grow with the paths.
    """
    down = cut(last_arcs(arcs))
    places = Levels(arcs.sparkSession, "walk")
    places.add(_start(down))
    for k in itertools.count(1) if max_levels is None else range(1, max_levels):
        if not places.add(_below(places.last(), down, k)):
            break
    return places.every()


def first_places(arcs: DataFrame) -> DataFrame:
    """The first place of each concept in pre-order, as walk has it: the least sort_key of its paths.

    Level by level, a place is followed only if it comes before the concept's places so far. A concept with many paths to it
    is so expanded once for each time that a longer path turns out to come first, not once for each path.
    """
    down = cut(last_arcs(arcs))
    found = Levels(arcs.sparkSession, "places")
    row = F.struct("sort_key", "parent", "level", "path", "weight")
    first = lambda places: places.groupBy(*TREE, "concept").agg(F.min(row).alias("r")).select(*TREE, "concept", "r.parent", "r.level", "r.path", "r.sort_key", "r.weight")
    some, k = found.add(_start(down).select(*TREE, "concept", "parent", "level", "path", "sort_key", "weight")), 0
    while some:
        k += 1
        before = found.every().groupBy(*TREE, "concept").agg(F.min("sort_key").alias("best"))
        better = first(_below(found.last(), down, k)).join(before, [*TREE, "concept"], "left").filter(F.col("best").isNull() | (F.col("sort_key") < F.col("best")))
        some = found.add(better.drop("best"))
    return first(found.every())


def levels(arcs: DataFrame, up: bool = True) -> DataFrame:
    """tree, concept, level: the most arcs from a concept down to a leaf or, if not up, from a root down to it.

    Concepts are peeled off level by level, each once and each arc once: a concept has its level as soon as all concepts below it
    have theirs. One in a cycle, or beyond one, never has: its level is null.
    """
    above, below = ("parent", "child") if up else ("child", "parent")
    edges = cut(arcs.select(*TREE, F.col(above).alias("above"), F.col(below).alias("below")).distinct())
    open_ = edges.groupBy(*TREE, F.col("above").alias("concept")).agg(F.count("*").alias("open"))
    ends = edges.select(*TREE, F.col("below").alias("concept")).distinct().join(open_, [*TREE, "concept"], "left_anti")
    state, k = Levels(arcs.sparkSession, "levels"), 0
    state.add(open_.unionByName(ends.withColumn("open", F.lit(0).cast("long"))).withColumn("level", F.when(F.col("open") == 0, 0)))
    some = True
    while some:
        k += 1
        closed = state.last().filter("level is not null").select(*TREE, F.col("concept").alias("below")).join(edges, [*TREE, "below"]).groupBy(*TREE, F.col("above").alias("concept")).agg(F.count("*").alias("closed"))
        waiting = state.last().filter("level is null").join(closed, [*TREE, "concept"], "left")
        left = F.col("open") - F.coalesce("closed", F.lit(0))
        some = state.add(waiting.select(*TREE, "concept", left.alias("open"), F.when(left == 0, k).alias("level")), "level is not null")
    return state.every().filter("level is not null").unionByName(state.last().filter("level is null")).select(*TREE, "concept", "level")


def depths(arcs: DataFrame) -> DataFrame:
    """Levels (a root alone is one), concepts and roots of each tree; no levels, null, where all concepts hang below a cycle or in it.

    Concepts below a cycle count as concepts, not as levels.
    """
    down = last_arcs(arcs)
    tops = roots(down).groupBy(*TREE).agg(F.count("*").alias("n_roots"))
    by_tree = levels(arcs, up=False).groupBy(*TREE).agg((F.max("level") + 1).cast("int").alias("max_depth"), F.count("*").alias("n_concepts"))
    return by_tree.join(tops, list(TREE), "left").withColumn("n_roots", F.coalesce("n_roots", F.lit(0)).cast("long"))


def recursive_walk(spark, arcs: DataFrame) -> DataFrame:
    """Tree, concept, parent, level and path by one recursive query, which stops by itself at the deepest level.

    Beyond the session's limits of levels and rows of a recursion it fails; walk has none.
    """
    arcs.createOrReplaceTempView("_walk_arcs")
    roots(arcs).createOrReplaceTempView("_walk_roots")
    return spark.sql("""
        WITH RECURSIVE walk(filing_id, role, concept, parent, level, path) AS (
          SELECT filing_id, role, concept, CAST(NULL AS STRING), 0, array(concept) FROM _walk_roots
          UNION ALL
          SELECT w.filing_id, w.role, a.child, w.concept, w.level + 1, concat(w.path, array(a.child))
          FROM walk w JOIN _walk_arcs a ON a.filing_id = w.filing_id AND a.role = w.role AND a.parent = w.concept
          WHERE NOT array_contains(w.path, a.child)
        )
        SELECT * FROM walk""")


def first_placements(walked: DataFrame) -> DataFrame:
    """The first place of each concept in pre-order; places below a dropped one are dropped too.

    A concept's kept place is the first whose whole path consists of kept places. Since a kept place comes with the
    first path to its parent, that is the place whose (parent's first place, own step) is the least.
    """
    best = walked.groupBy(*TREE, "concept").agg(F.min("sort_key").alias("sort_key"))
    return walked.join(best, [*TREE, "concept", "sort_key"])


def depth(walked: DataFrame) -> DataFrame:
    """Levels (a root alone is one), concepts and roots of each tree."""
    return walked.groupBy(*TREE).agg((F.max("level") + 1).alias("max_depth"), F.count_distinct("concept").alias("n_concepts"), F.count_if(F.col("level") == 0).alias("n_roots"))


def path_to_root(arcs: DataFrame, max_levels: int | None = None) -> DataFrame:
    """Each concept's path upward: always to the parent that comes first in the input."""
    first = arcs.groupBy(*TREE, "child").agg(F.min_by(F.struct(*[c for c in arcs.columns if c not in (*TREE, "child")]), "arc_seq").alias("a"))
    return walk(first.select(*TREE, "child", "a.*"), max_levels).select(*TREE, "concept", F.reverse("path").alias("path"))
