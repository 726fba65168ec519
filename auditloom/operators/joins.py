"""Joins on ranges and parts of texts, as equi-joins on buckets or pieces, so that no key's rows all meet each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def within(instants: DataFrame, durations: DataFrame, by: list[str], at: str, start: str, end: str, width: int) -> DataFrame:
    """Rows of instants beside the rows of durations of the same owner (by) that hold their date, both ends included.

    Dates fall in buckets of width days. A duration goes to each bucket that it touches and an instant to its own, so
    that each pair meets once. A width like the usual length of a duration makes about two copies of it. A null date
    or a duration that ends before it starts matches nothing.
    """
    number = lambda c: F.floor(F.unix_date(F.col(c)) / width)
    bucket = "_".join(["bucket", *instants.columns, *durations.columns])  # a name that no column has
    spread = durations.filter(F.col(start) <= F.col(end)).withColumn(bucket, F.explode(F.sequence(number(start), number(end))))
    met = instants.withColumn(bucket, number(at)).join(spread, [*by, bucket])
    return met.filter(F.col(at).between(F.col(start), F.col(end))).drop(bucket)


def near(left: DataFrame, right: DataFrame, by: list[str], at: str, other: str, days: int) -> DataFrame:
    """Rows of left beside the rows of right of the same owner whose dates are at most some days apart."""
    low, high = (f"_{end}_" + "_".join(right.columns) for end in ("low", "high"))
    spread = right.withColumn(low, F.date_sub(other, days)).withColumn(high, F.date_add(other, days))
    return within(left, spread, by, at, low, high, 2 * days + 1).drop(low, high)


def _pieces(names: DataFrame, texts: DataFrame, name: str, text: str, upto: int = 0) -> DataFrame:
    """names beside each different piece of them: of up to some characters, and of the lengths that longer texts have."""
    longer = F.sort_array(F.collect_set(F.when(~F.length(text).between(1, upto), F.length(text))))
    lengths = texts.agg(F.concat(F.array(*[F.lit(k) for k in range(1, upto + 1)]).cast("array<int>"), longer).alias("_lengths"))  # one row of numbers
    of_length = lambda k: F.transform(F.sequence(F.lit(1), F.length(name) - k + 1), lambda i: F.substring(F.col(name), i, k))
    short_enough = F.filter("_lengths", lambda k: k <= F.length(name))
    cut = F.array_distinct(F.flatten(F.transform(short_enough, of_length)))
    return names.filter(F.col(name).isNotNull()).join(F.broadcast(lengths)).withColumn("piece", F.explode(cut)).drop("_lengths")


def first_holding(texts: DataFrame, names: DataFrame, by: list[str], piece: int = 3) -> DataFrame:
    """by, text and the least id of the names of the same class (by) that equal the text, else of those that hold it.

    texts: by, text; names: by, id, name. Names are indexed by their pieces of up to some characters and by those of the
    lengths of longer texts, the least id for each, so that a text meets one row however many names hold it: the rows grow with
    the names and not with the pairs. Each different text is looked up once. A null or empty text has no row, and neither has one
    that no name holds.
    """
    wanted = texts.select(*by, "text").filter(F.length("text") > 0).distinct()
    each = names.groupBy(*by, "name").agg(F.min("id").alias("id"))
    pieces = _pieces(each, wanted, "name", "text", piece)
    known = pieces.groupBy(*by, F.col("piece").alias("text")).agg(F.min(F.struct((F.col("name") != F.col("piece")).alias("other"), "id")).alias("b"))
    return wanted.join(known, [*by, "text"]).select(*by, "text", "b.id")


def holding(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs of a text (column text) and a name (column name) that holds it, each once, by the names' pieces of the texts' lengths."""
    wanted, each = texts.select("text").filter("text is not null").distinct(), names.select("name").distinct()
    return _pieces(each, wanted, "name", "text").join(wanted.withColumnRenamed("text", "piece"), "piece").select(F.col("piece").alias("text"), "name")
