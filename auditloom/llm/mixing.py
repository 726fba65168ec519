"""Mixing sources to target weights by Pareto order sampling.

Each source has a target number of words. Documents of a source fall into size classes; shorter ones get somewhat
more copies. The expected copies of a document are split into certain whole copies and an inclusion probability p.
The fixed size left over is filled in Pareto order: documents are ranked by their random odds u / (1 - u) divided by
their inclusion odds p / (1 - p), and the lowest are taken.

Everything works on (source, size class) and (source, rank bucket) totals, added up before they are shuffled. Only
the documents of one rank bucket of a source are ever sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.common import Scratch, n_words

#: Most times that a document may be taken.
MOST = 3
#: Weights of the sources in code point order, repeated as often as needed.
WEIGHTS = (5, 2, 1)
#: Rank buckets of a source.
BUCKETS = 4096
#: Copies fall as size to this power.
TILT = 0.125


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target from (source, size).

    All sizes are shared out by weight, in code point order of the sources, null last. A target stops at most times
    its source's size, and the excess goes to the others by weight until none is above. So target is the lesser of
    that limit and weight times a common level; sources reach their limits in the order of limit / weight, which
    gives the level from running totals. Only totals by source are sorted here.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (order % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * float(most)
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(1))
    ranked = totals.withColumn("weight", weight).withColumn("cap", cap)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("weight").over(after)
    return (
        ranked.withColumn("level", level)
        # The level is that of the first source, in this order, which does not reach its limit.
        .withColumn("place", F.row_number().over(by))
        .withColumn("level", F.min_by("level", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("place"))).over(every))
        .select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))
    )


def _class_copies(classes: DataFrame, most: int) -> DataFrame:
    """Expected copies of each (source, size class) with its words: the lesser of most and a level times its tilt."""
    of = Window.partitionBy("source")
    by = of.orderBy(F.col("class").asc())  # the least size has the largest tilt and meets the limit first
    upto, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    tilted = classes.withColumn("tilt", F.pow(F.lit(2.0), -F.col("class") * TILT)).withColumn("pull", F.col("tilt") * F.col("words"))
    level = (F.col("target") - most * F.coalesce(F.sum("words").over(upto), F.lit(0))) / F.sum("pull").over(after)
    return (
        tilted.withColumn("level", level)
        .withColumn("level", F.min_by("level", F.when(F.col("level") * F.col("tilt") <= most, F.col("class"))).over(of))
        .withColumn("copies", F.least(F.lit(float(most)), F.coalesce(F.col("level") * F.col("tilt"), F.lit(float(most)))))
        .drop("tilt", "pull", "level")
    )


def uniform(seed: int, *columns: str | Column) -> Column:
    """A number between 0 and 1, the ends not included, that depends on the columns and the seed alone."""
    return (F.shiftrightunsigned(F.xxhash64(*columns, F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(2**53))


def mix(docs: DataFrame, seed: int = 11, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """How often each document goes into the mix.

    docs: doc_id, text, source. Returns doc_id, text_hash, size, source_size, target, copies and taken, a row for each row of
    docs: size is the number of words (null text: 0), taken is copies times size, and copies is at most ``most``.
    text_hash is a 64-bit hash of the text. The words taken of a source are within half the size of one document of
    its target. A null source is one
    source, last in order. A document without words is taken 0 times. Rows that repeat a doc_id draw by their text
    too; rows equal in both share one draw and fall in order of nothing else. The seed fixes the result.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    size = n_words("text")
    sized = scratch.write(
        docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.xxhash64("text").alias("text_hash"), size.alias("size"), uniform(seed, F.col("doc_id").cast("long"), F.col("text")).alias("u")).withColumn(
            "class", F.when(F.col("size") > 0, F.floor(F.log2("size"))).otherwise(0).cast("int")
        )
    )
    targets = scratch.write(source_targets(sized, weights, most))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    classes = sized.filter("size > 0").groupBy("source", "class").agg(F.sum("size").alias("words"))
    classes = classes.join(targets, same(classes, targets)).drop(targets["source"])
    nearest = F.round("copies")  # a whole number but for rounding is whole
    snapped = F.when(F.abs(F.col("copies") - nearest) < 1e-9, nearest).otherwise(F.col("copies"))
    plan = scratch.write(_class_copies(classes, most).withColumn("copies", snapped).withColumn("whole", F.floor("copies")).withColumn("p", F.col("copies") - F.col("whole")))

    odds = lambda p: p / (1 - p)
    q = odds(F.col("u")) / odds(F.col("p"))
    s, p = sized.alias("s"), plan.alias("p")
    ranked = (
        s.join(p, F.col("s.source").eqNullSafe(F.col("p.source")) & (F.col("s.class") == F.col("p.class")) & (F.col("s.size") > 0), "left")
        .select("doc_id", "text_hash", "s.source", "size", "u", F.coalesce("whole", F.lit(0)).alias("whole"), F.when(F.col("p") > 0, q / (1 + q)).alias("rank"))
        .withColumn("bucket", F.floor(F.col("rank") * BUCKETS).cast("int"))
    )
    ranked = scratch.write(ranked)
    left = plan.groupBy("source").agg((F.first("target") - F.sum(F.col("whole") * F.col("words"))).alias("left"))
    buckets = ranked.filter("rank is not null").groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
    # The bucket in which a source's words reach what is left: none before the first if nothing is, the one after all if they don't.
    b, t = buckets.alias("b"), left.alias("t")
    reached = F.col("t.source").eqNullSafe(F.col("b.source")) & (F.col("before") < F.col("left")) & (F.col("before") + F.col("words") >= F.col("left"))
    edge = t.join(b, reached, "left").select("t.source", F.when(F.col("left") <= 0, -1).otherwise(F.coalesce("bucket", F.lit(BUCKETS))).alias("edge"), "before", "left")
    r, e = ranked.alias("r"), edge.alias("e")
    placed = r.join(e, F.col("r.source").eqNullSafe(F.col("e.source")), "left").select("doc_id", "text_hash", "r.source", "size", "u", "whole", "rank", "bucket", "edge", "before", "left")
    inside = placed.filter("rank is not null and bucket = edge")
    upto = Window.partitionBy("source").orderBy("rank", "doc_id", "size", "u").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(upto), F.lit(0))).withColumn("extra", (F.col("start") + F.col("size") / 2 <= F.col("left")).cast("int"))
    outside = placed.filter("rank is null or edge is null or bucket != edge").withColumn("extra", F.coalesce((F.col("bucket") < F.col("edge")).cast("int"), F.lit(0)))
    cols = ["doc_id", "text_hash", "source", "size", (F.col("whole") + F.col("extra")).cast("int").alias("copies")]
    taken = outside.select(*cols).unionByName(inside.select(*cols))
    k, g = taken.alias("k"), targets.alias("g")
    return k.join(g, F.col("k.source").eqNullSafe(F.col("g.source")), "left").select(
        "doc_id", "text_hash", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken")
    )


def mixed(docs: DataFrame, seed: int = 11, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The rows of docs themselves, each as often as mix takes it. Rows equal in doc_id and text get the same number."""
    plan = mix(docs, seed, weights, most).filter("copies > 0").groupBy("doc_id", "text_hash").agg(F.max("copies").alias("copies"))
    d, p = docs.alias("d"), plan.alias("p")
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("p.doc_id")) & (F.xxhash64("d.text") == F.col("p.text_hash"))
    copy = "_" + "_".join(docs.columns)  # a name that no column has
    return d.join(p, same).select("d.*", F.explode(F.sequence(F.lit(1), F.col("p.copies"))).alias(copy)).drop(copy)
