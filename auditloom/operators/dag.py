"""Totals of totals: calculations rolled up bottom-up over acyclic networks, each concept once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions import numbers as N
from auditloom.operators.hierarchy import TREE, levels
from auditloom.operators.lineage import Levels, cut


def rollup_dag(arcs: DataFrame, facts: DataFrame, least: float = 0.5) -> DataFrame:
    """Each calculated concept in each context, from what lies below it: its computed and its reported value.

    arcs: filing_id, role, parent, child, weight, of which the last (by arc_seq) of equal ones counts. facts: filing_id,
    context_id, concept, value (one row for each, as classify_duplicates leaves them), decimals. The value of a child is its
    computed one if it is calculated itself and could be, else its reported one. A concept can be computed in a context if at
    least a share ``least`` of its children have a value there; it then is the weighted sum of those.

    Returns filing_id, role, context_id, concept, level, n_children, n_found, computed, reported, status (checked, computed
    for one that is not reported, incomplete for a reported one with too few children, circular for a reported one in or above a cycle), passed and difference
    (checked ones). Levels go up from the leaves; each arc is joined once, at its parent's level, whatever number of paths
    lead over it. A value is compared to within the tolerance of roll-ups, by the lowest decimals of what it was summed from.
    """
    last = arcs.groupBy(*TREE, "parent", "child").agg(F.max_by("weight", "arc_seq").alias("weight"))
    placed = cut(levels(arcs))
    down = cut(last.join(placed.withColumnRenamed("concept", "parent"), [*TREE, "parent"]).select(*TREE, "parent", "child", F.coalesce("weight", F.lit(1.0)).alias("weight"), "level"))
    sizes = down.groupBy(*TREE, F.col("parent").alias("concept"), "level").agg(F.count("*").alias("n_children"))
    highest = down.agg(F.max("level")).first()[0] or 0  # one number

    concepts = placed.join(sizes.drop("level"), [*TREE, "concept"], "left")  # leaves have no children
    own = cut(facts.join(concepts, ["filing_id", "concept"]).select(*TREE, "context_id", "concept", "level", "n_children", F.col("value").alias("reported"), F.col("decimals").alias("reported_decimals")))
    none = lambda kind: F.lit(None).cast(kind)
    unsummed = own.select(*TREE, "context_id", "concept", "level", "n_children", F.lit(0).cast("long").alias("n_found"), none("double").alias("computed"), none("int").alias("decimals"), "reported", "reported_decimals")
    effective = Levels(arcs.sparkSession, "dag")
    effective.add(unsummed.filter("n_children is null"))
    for k in range(1, highest + 1):
        computed = F.col("computed").isNotNull()
        below = effective.every().select(*TREE, "context_id", F.col("concept").alias("child"), F.coalesce("computed", "reported").alias("v"), F.when(computed, F.col("decimals")).otherwise(F.col("reported_decimals")).alias("d")).filter("v is not null")
        summed = down.filter(F.col("level") == k).join(below, [*TREE, "child"]).groupBy(*TREE, "context_id", F.col("parent").alias("concept")).agg(
            F.count("*").alias("found"), F.sum((F.col("v") * F.col("weight")).cast("decimal(38,6)")).cast("double").alias("sum"), F.min("d").alias("d")
        )
        sized = summed.join(sizes.select(*TREE, "concept", F.col("n_children").alias("n")), [*TREE, "concept"])
        both = sized.join(own.filter(F.col("level") == k).drop("level"), [*TREE, "context_id", "concept"], "full_outer")
        n, found = F.coalesce("n", "n_children"), F.coalesce("found", F.lit(0)).cast("long")
        effective.add(both.select(*TREE, "context_id", "concept", F.lit(k).alias("level"), n.alias("n_children"), found.alias("n_found"), F.when(found >= n * least, F.col("sum")).alias("computed"), F.col("d").alias("decimals"), "reported", "reported_decimals"))

    rows = effective.every().filter("n_children is not null").unionByName(unsummed.filter("level is null and n_children is not null"))
    status = F.when(F.col("level").isNull(), "circular").when(F.col("computed").isNull(), "incomplete").when(F.col("reported").isNull(), "computed").otherwise("checked")
    passed = N.within_tolerance(F.col("computed"), F.col("reported"), F.col("decimals"), F.col("reported_decimals"))
    out = rows.withColumn("status", status).filter("status in ('checked', 'computed') or reported is not null")
    return out.select(
        *TREE, "context_id", "concept", "level", "n_children", "n_found", "computed", "reported", "status",
        F.when(F.col("status") == "checked", passed).alias("passed"), F.when(F.col("status") == "checked", F.abs(F.col("computed") - F.col("reported"))).alias("difference"),
    )


def calculation_trees(arcs: DataFrame) -> DataFrame:
    """Each calculated concept of each network: level, direct children, concepts that the whole calculation rests on, whether it is a top one.

    n_below counts distinct concepts below, by sets that grow level by level over arcs, so it takes as many rows as there are pairs
    of a concept and one below it.
    """
    placed = cut(levels(arcs))
    edges = cut(arcs.select(*TREE, "parent", "child").distinct())
    reach, new = Levels(arcs.sparkSession, "reach"), Levels(arcs.sparkSession, "reached")
    some = new.add(edges.select(*TREE, F.col("parent").alias("concept"), F.col("child").alias("below")))
    reach.add(new.last())
    while some:
        step = new.last().join(edges.withColumnsRenamed({"parent": "below", "child": "next"}), [*TREE, "below"]).select(*TREE, "concept", F.col("next").alias("below")).distinct()
        some = new.add(step.join(reach.every(), [*TREE, "concept", "below"], "left_anti"))
        reach.add(new.last())
    new.drop()
    below = reach.every().groupBy(*TREE, "concept").agg(F.count("*").alias("n_below"))
    children = edges.groupBy(*TREE, F.col("parent").alias("concept")).agg(F.count("*").alias("n_children"))
    inner = edges.select(*TREE, F.col("child").alias("concept")).distinct().withColumn("inner", F.lit(True))
    out = children.join(placed, [*TREE, "concept"]).join(below, [*TREE, "concept"]).join(inner, [*TREE, "concept"], "left")
    return out.select(*TREE, "concept", "level", "n_children", "n_below", F.col("inner").isNull().alias("is_top"))


def registry_summary(company: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """What two sources of calculations hold, in one row: trees (role, parent) and parents of each, parents of either, and how many parents agree.

    Parents agree if both sources have them with the same children and weights, over all their roles together.
    """
    one = lambda df, name: df.agg(F.count_distinct("role", "parent").alias(f"{name}_trees"), F.count_distinct("parent").alias(f"{name}_concepts"))
    weights = lambda df, w: df.groupBy("parent", "child").agg(F.max_by("weight", "arc_seq").alias(w))
    both = weights(company, "a").join(weights(taxonomy, "b"), ["parent", "child"], "full_outer")
    agree = both.groupBy("parent").agg(F.every(F.col("a").eqNullSafe(F.col("b"))).alias("same")).agg(F.count("*").alias("total_unique_concepts"), F.count_if("same").alias("matches"))
    return one(company, "company").join(one(taxonomy, "taxonomy")).join(agree).withColumn("mismatches", F.col("total_unique_concepts") - F.col("matches"))  # three rows of totals
