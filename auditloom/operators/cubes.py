"""Facts against hypercubes: which members a concept may be reported with, by the definition arcs of its roles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.operators.contexts import entries
from auditloom.operators.lineage import Levels


def _reach(arcs: DataFrame) -> DataFrame:
    """role, above, below: all pairs along arcs (role, parent, child), a concept with itself included. Cycles do no harm."""
    edges = arcs.select("role", "parent", "child").distinct()
    names = edges.select("role", F.explode(F.array("parent", "child")).alias("above")).distinct()
    found, new = Levels(arcs.sparkSession, "reach"), Levels(arcs.sparkSession, "reached")
    some = new.add(names.withColumn("below", F.col("above")))
    found.add(new.last())
    while some:
        step = new.last().join(edges.withColumnsRenamed({"parent": "below", "child": "next"}), ["role", "below"]).select("role", "above", F.col("next").alias("below")).distinct()
        some = new.add(step.join(found.every(), ["role", "above", "below"], "left_anti"))
        found.add(new.last())
    new.drop()
    return found.every()


def allowed(arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cubes by concept, and the members of their dimensions.

    arcs: role, arcrole (its last segment), parent, child, closed. Cubes: role, concept, cube, kind (all or notAll), closed,
    n_dims, defaults (how many dimensions have a default), where a cube of a concept also holds for the concepts below it over domain-member arcs. Members: role, cube,
    dimension, member, is_default; those of a dimension are its domains and all below them over domain-member arcs.
    """
    of = lambda *kinds: arcs.filter(F.col("arcrole").isin(*kinds))
    below = _reach(of("domain-member"))
    heads = of("all", "notAll").select("role", F.col("parent").alias("above"), F.col("child").alias("cube"), F.col("arcrole").alias("kind"), F.coalesce("closed", F.lit(False)).alias("closed")).distinct()
    concepts = heads.join(below, ["role", "above"], "left").select("role", F.coalesce("below", "above").alias("concept"), "cube", "kind", "closed").distinct()
    dims = of("hypercube-dimension").select("role", F.col("parent").alias("cube"), F.col("child").alias("dimension")).distinct()
    domains = of("dimension-domain").select("role", F.col("parent").alias("dimension"), F.col("child").alias("above")).distinct()
    defaults = of("dimension-default").select("role", F.col("parent").alias("dimension"), F.col("child").alias("default")).distinct()
    inside = domains.join(below, ["role", "above"], "left").select("role", "dimension", F.coalesce("below", "above").alias("member")).distinct()
    sizes = dims.join(defaults.groupBy("role", "dimension").agg(F.lit(1).alias("d")), ["role", "dimension"], "left").groupBy("role", "cube").agg(F.count("*").alias("n_dims"), F.count("d").alias("defaults"))
    members = dims.join(inside, ["role", "dimension"]).join(defaults, ["role", "dimension"], "left").select("role", "cube", "dimension", "member", F.col("member").eqNullSafe(F.col("default")).alias("is_default"))
    named = members.groupBy("role", "cube", "dimension", "member").agg(F.bool_or("is_default").alias("is_default"))
    every = dims.join(defaults, ["role", "dimension"], "left").groupBy("role", "cube", "dimension").agg(F.bool_or(F.col("default").isNotNull()).alias("has_default"))
    cubes = concepts.join(sizes, ["role", "cube"], "left").select("role", "concept", "cube", "kind", "closed", F.coalesce("n_dims", F.lit(0)).alias("n_dims"), F.coalesce("defaults", F.lit(0)).alias("defaults"))
    return cubes, every.join(named, ["role", "cube", "dimension"], "left")


def dimensional_validity(facts: DataFrame, arcs: DataFrame) -> DataFrame:
    """filing_id, concept, dims (as text), n_facts, status of each concept with each set of members it is reported with.

    facts: filing_id, concept, dims (map of dimensions to members). A set fits a cube if each dimension of the cube has an
    allowed member, its default where the set says nothing, and, in a closed cube, there is no further dimension; a default
    that is given as a member does not fit. In a role a set is valid if it fits all cubes of kind all and none of kind notAll
    that the concept has there. Status: valid in a role, else excluded (a notAll cube fits where the others do), else
    invalid; uncovered for concepts without cubes.

    Facts are first counted by concept and set. A set's members then meet the members of the concept's cubes in an equi-join
    on dimension and member, and are counted: no fact meets a cube that is not its concept's.
    """
    text = F.array_join(F.transform(entries(F.col("dims")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), ";")
    sets = facts.groupBy("filing_id", "concept", text.alias("dims_text")).agg(F.count("*").alias("n_facts"), F.first(F.transform(entries(F.col("dims")), lambda e: F.struct(e["key"].alias("dimension"), e["value"].alias("member")))).alias("set"))
    cubes, members = allowed(arcs)
    shapes = sets.select("concept", "dims_text", "set").dropDuplicates(["concept", "dims_text"])
    pairs = shapes.join(cubes, "concept")
    given = pairs.select("role", "concept", "cube", "kind", "dims_text", F.explode("set").alias("e")).select("role", "concept", "cube", "kind", "dims_text", "e.dimension", "e.member")
    dims = members.select("role", "cube", "dimension", "has_default").distinct()
    known = given.join(dims, ["role", "cube", "dimension"]).join(members.select("role", "cube", "dimension", "member", "is_default"), ["role", "cube", "dimension", "member"], "left")
    keys = ["role", "concept", "cube", "kind", "dims_text"]
    met = known.groupBy(*keys).agg(F.count("*").alias("n_given"), F.count_if(F.col("is_default") == F.lit(False)).alias("n_right"), F.count_if("has_default").alias("given_defaults"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    joined = pairs.select(*keys, "closed", "n_dims", "defaults", F.size("set").alias("n_set")).join(met, keys, "left")
    by_default = F.col("defaults") - zero("given_defaults")
    fits = (zero("n_right") == zero("n_given")) & (zero("n_given") + by_default == F.col("n_dims")) & (~F.col("closed") | (F.col("n_set") == zero("n_given")))
    roles = joined.withColumn("fits", fits).groupBy("role", "concept", "dims_text").agg(F.every(F.when(F.col("kind") == "all", F.col("fits"))).alias("right"), F.bool_or(F.when(F.col("kind") == "notAll", F.col("fits"))).alias("out"))
    right, out = F.coalesce("right", F.lit(True)), F.coalesce("out", F.lit(False))
    verdict = roles.groupBy("concept", "dims_text").agg(F.bool_or(right & ~out).alias("valid"), F.bool_or(right & out).alias("excluded"))
    status = F.when(F.col("valid").isNull(), "uncovered").when(F.col("valid"), "valid").when(F.col("excluded"), "excluded").otherwise("invalid")
    return sets.join(verdict, ["concept", "dims_text"], "left").select("filing_id", "concept", F.col("dims_text").alias("dims"), "n_facts", status.alias("status"))
