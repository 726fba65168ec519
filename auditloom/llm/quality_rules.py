"""Quality rules: robust multivariate outliers of text statistics, in DataFrame functions only.

Each text has a vector of transformed statistics. For each language and source the minimum covariance determinant
estimate (the mean and covariance of the 75 % of the texts whose covariance has the least determinant) is approached
by concentration steps from two starts, and texts with a large Mahalanobis distance from it are rejected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import Scratch

SPACE = r"[\x20\x09-\x0D]+"
#: Share of texts in the central subset, concentration steps, rows that a group needs for estimates of its own.
CENTRAL, STEPS, LEAST_ROWS = 0.75, 3, 60
#: Squared distance from which a text is rejected: the 99.99 % point of chi-square with 4 degrees of freedom.
CUTOFF = 23.51
#: Makes the covariance of the central 75 % of a normal sample in 4 dimensions consistent.
CONSISTENT = 1.487
#: Statistics, their transformed values and the standard deviations below which none is taken to be.
STATS = {"x0": 0.05, "x1": 0.5, "x2": 0.5, "x3": 0.12}
P = len(STATS)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each whole text; a null text counts as empty.

    n_repeat_words counts the words that lie in a 3-word window found twice or more in the text. Windows are told
    apart by 64-bit hashes.
    """
    text = F.coalesce("text", F.lit(""))
    words = docs.select(F.col("doc_id").cast("long"), "lang", "source", text.alias("text"), F.array_remove(F.split(text, SPACE), "").alias("w"))
    counted = words.select(
        "doc_id",
        "lang",
        "source",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0).alias("lines"),
        F.sort_array(
            F.transform(F.slice("w", 1, F.greatest(F.size("w") - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("i")))
        ).alias("s"),
    )
    twice = counted.withColumn(
        "at",
        F.sort_array(
            F.filter(
                F.transform("s", lambda x, k: F.when((x["h"] == F.get("s", k - 1)["h"]) | (x["h"] == F.get("s", k + 1)["h"]), x["i"])),
                lambda x: x.isNotNull(),
            )
        ),
    )
    covered = F.aggregate(
        "at",
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return twice.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), covered.alias("n_repeat_words")
    )


def _vector(n: Column) -> dict[str, Column]:
    return {
        "x0": F.log(F.col("word_chars") / n),
        "x1": F.log1p(100 * F.col("n_symbols") / n),
        "x2": F.log1p(100 * F.col("n_dup_lines") / n),
        "x3": F.asin(F.sqrt(F.least(F.col("n_repeat_words") / n, F.lit(1.0)))),
    }


def _moments(weight: Column | None = None) -> list[Column]:
    """Count, means and covariances as aggregates; rows where weight is not true are left out."""
    at = {k: (F.when(weight, F.col(k)) if weight is not None else F.col(k)) for k in STATS}
    out = [F.count(at["x0"]).alias("n"), *(F.avg(at[f"x{i}"]).alias(f"m{i}") for i in range(P))]
    return out + [F.covar_pop(at[f"x{i}"], at[f"x{j}"]).alias(f"c{i}{j}") for i, j in PAIRS]


def _factored(params: DataFrame, scale: float = 1.0) -> DataFrame:
    """Adds the Cholesky factor l_ij of the covariance (times scale, variances raised by the floors) and log_det."""
    floors = list(STATS.values())
    for i, j in PAIRS:
        rest = F.col(f"c{i}{j}") * scale + (floors[i] ** 2 if i == j else 0.0)
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        params = params.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(floors[i] ** 2 / 4))) if i == j else rest / F.col(f"l{j}{j}"))
    return params.withColumn("log_det", reduce(lambda a, b: a + b, (F.log(F.col(f"l{i}{i}")) for i in range(P))))


def _distance() -> Column:
    """Squared Mahalanobis distance of x from m, with the covariance's Cholesky factor l, by forward substitution."""
    y: list[Column] = []
    for i in range(P):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * y[k]
        y.append(rest / F.col(f"l{i}{i}"))
    return reduce(lambda a, b: a + b, (v * v for v in y))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang, source → doc_id, n_words, counts, base_failed, distance and kept, a row for each row.

    base_failed: under 50 words, or over half of the words in repeated 3-word windows. Others are judged against
    their group, the documents of equal lang and source (null is a value of its own). Groups of under LEAST_ROWS
    such documents are pooled by language, pools that are still smaller all together; if even that pool is smaller,
    its documents are kept. An empty table gives an empty result; equal rows get equal verdicts.
    """
    scratch = Scratch(docs.sparkSession, "rules")
    counts = statistics(docs).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    key = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    base = scratch.write(counts.select("*", key("lang", "source").alias("g1"), key("lang").alias("g2"), *[v.alias(k) for k, v in _vector(n).items()]))

    size1 = base.filter("not base_failed").groupBy("g1", "g2").agg(F.count("*").alias("n1"))
    pooled = size1.withColumn("g", F.when(F.col("n1") >= LEAST_ROWS, F.col("g1")).otherwise(F.col("g2")))
    size2 = pooled.groupBy("g").agg(F.sum("n1").alias("n2"))
    groups = scratch.write(pooled.join(size2, "g").select("g1", F.when(F.col("n2") >= LEAST_ROWS, F.col("g")).otherwise("all").alias("g")))
    x = base.filter("not base_failed").join(groups, "g1").select("g", *STATS)

    quartiles = x.groupBy("g").agg(*_moments(), *[F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75]).alias(f"q{i}") for i in range(P)])
    robust = [(F.pow((F.get(f"q{i}", F.lit(2)) - F.get(f"q{i}", F.lit(0))) / 1.349, 2) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in PAIRS]
    starts = quartiles.select("g", F.lit(0).alias("start"), "n", *[F.get(f"q{i}", F.lit(1)).alias(f"m{i}") for i in range(P)], *robust)
    params = scratch.write(_factored(starts.unionByName(quartiles.select("g", F.lit(1).alias("start"), "n", *[f"m{i}" for i in range(P)], *[f"c{i}{j}" for i, j in PAIRS]))))
    for _ in range(STEPS):
        far = x.join(params, "g").select("g", "start", *STATS, _distance().alias("d"))
        limit = scratch.write(far.groupBy("g", "start").agg(F.percentile_approx("d", CENTRAL).alias("limit")))
        params = scratch.write(_factored(far.join(limit, ["g", "start"]).groupBy("g", "start").agg(*_moments(F.col("d") <= F.col("limit")))))
    best = params.groupBy("g").agg(F.min_by("start", F.struct("log_det", "start")).alias("start"), F.count("*").alias("starts"))
    final = _factored(params.drop(*[f"l{i}{j}" for i, j in PAIRS], "log_det").join(best, ["g", "start"]), CONSISTENT)
    sized = final.withColumn("enough", F.col("n") >= CENTRAL * LEAST_ROWS)
    verdict = scratch.write(groups.join(sized.drop("start", "starts", "n"), "g"))
    ok = F.col("base_failed")
    return base.join(verdict, "g1", "left").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        F.when(~ok & F.col("enough"), _distance()).alias("distance"),
        (~ok & F.coalesce(~F.col("enough") | (_distance() < CUTOFF), F.lit(True))).alias("kept"),
    )
