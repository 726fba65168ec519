"""Exports: statements, catalogs, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditloom.functions.names import safe_name

# Columns of the statement export, in order.
STATEMENT_COLUMNS = ("concept", "value", "unit", "decimals", "context_id", "period_start", "period_end", "order", "depth", "parent_concept", "label")


def write_statements(facts: DataFrame, path: str, fmt: str = "json", by: tuple[str, ...] = ("category",)) -> None:
    """Facts of statements in folders by category; csv has STATEMENT_COLUMNS with empty text for nulls."""
    if fmt == "csv":
        facts.select(*by, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in STATEMENT_COLUMNS]).write.partitionBy(*by).option("header", "true").csv(path)
    elif fmt in ("json", "parquet", "orc"):
        facts.write.partitionBy(*by).format(fmt).save(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


# Folders of the export by category of a statement's network; others go to "other".
ROUTES = {"CORE_STATEMENT": "core", "DETAIL": "details"}


def routed(facts: DataFrame) -> DataFrame:
    """facts (filing_id, stmt_seq, title, category, ...) with route and file_name, by which a statement's file is known.

    Names are unique within a filing and route: a statement whose safe name an earlier one has (by stmt_seq) gets _2, _3, ...
    Names are given once for each statement, not for each fact.
    """
    route = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ROUTES.items() for x in kv]), F.col("category")), F.lit("other"))
    statements = facts.select("filing_id", "stmt_seq", "title", route.alias("route")).distinct()
    base = safe_name(F.lower("title"), 80)
    n = F.row_number().over(Window.partitionBy("filing_id", "route", "base").orderBy("stmt_seq"))
    named = statements.withColumn("base", base).withColumn("file_name", F.when(n == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), n)))
    return facts.join(named.select("filing_id", "stmt_seq", "route", "file_name"), ["filing_id", "stmt_seq"])


def export(facts: DataFrame, path: str, batch: str) -> None:
    """Writes the facts of a batch of filings below path, and then a manifest of what was written.

    Statements lie in folders by batch and route. A batch that is exported again replaces its own folders and nothing else, so
    that a repeated or resumed export leaves the same files as one that ran once. The manifest comes last: what has no manifest was not finished.
    """
    rows = routed(facts).withColumn("batch", F.lit(batch))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "route").parquet(f"{path}/statements")
    written = facts.sparkSession.read.schema(rows.schema).parquet(f"{path}/statements").filter(F.col("batch") == batch)
    manifest(written).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/manifest")


def manifest(rows: DataFrame) -> DataFrame:
    """batch, filing_id, route, file_name, n_facts and digest of each exported statement; the digest does not depend on the order of facts."""
    own = [c for c in rows.columns if c not in ("batch", "route")]
    return rows.groupBy("batch", "filing_id", "route", "file_name").agg(F.count("*").alias("n_facts"), F.bit_xor(F.xxhash64(*own)).alias("digest"))


def exported(spark: SparkSession, path: str) -> DataFrame:
    """The exported facts of finished batches."""
    done = spark.read.parquet(f"{path}/manifest").select("batch").distinct()
    return spark.read.parquet(f"{path}/statements").join(done, "batch", "left_semi")


def damaged(spark: SparkSession, path: str) -> DataFrame:
    """batch, filing_id, route, file_name of the statements that are not as the manifest has them, or that it doesn't have."""
    keys = ["batch", "filing_id", "route", "file_name"]
    now = manifest(spark.read.parquet(f"{path}/statements")).select(*keys, F.struct("n_facts", "digest").alias("now"))
    then = spark.read.parquet(f"{path}/manifest").select(*keys, F.struct("n_facts", "digest").alias("then"))
    return now.join(then, keys, "full_outer").filter(~F.col("now").eqNullSafe(F.col("then"))).select(*keys)


def statement_json(facts: DataFrame, info: DataFrame) -> DataFrame:
    """A JSON text for each core statement: filing_id, stmt_seq, json with the filing's info, the statement and its facts in order.

    facts: filing_id, stmt_seq, title, category, fact_seq and the columns that a fact shows. info: filing_id and what is shown of a filing. A
    statement is a row, so that no row holds a whole filing; core_info heads them.
    """
    core = facts.filter(F.col("category") == "CORE_STATEMENT")
    shown = [c for c in facts.columns if c not in ("filing_id", "stmt_seq", "title", "category")]
    one = core.groupBy("filing_id", "stmt_seq", "title").agg(F.array_sort(F.collect_list(F.struct("fact_seq", *[c for c in shown if c != "fact_seq"]))).alias("facts"), F.count("*").alias("total_facts"))
    about = info.select("filing_id", F.struct(*[c for c in info.columns if c != "filing_id"]).alias("filing_info"))
    return one.join(about, "filing_id", "left").select("filing_id", "stmt_seq", F.to_json(F.struct("filing_info", "title", "total_facts", "facts")).alias("json"))


def core_info(facts: DataFrame) -> DataFrame:
    """filing_id, core_statement_count, n_facts, titles of the core statements in order: what stands above them in one file."""
    core = facts.filter(F.col("category") == "CORE_STATEMENT").groupBy("filing_id", "stmt_seq", "title").agg(F.count("*").alias("n"))
    return core.groupBy("filing_id").agg(F.count("*").alias("core_statement_count"), F.sum("n").alias("n_facts"), F.transform(F.array_sort(F.collect_list(F.struct("stmt_seq", "title"))), lambda s: s["title"]).alias("titles"))


def simplified(facts: DataFrame) -> DataFrame:
    """Totals of each statement: filing_id, stmt_seq, concept, value, label, period_end of the statement.

    facts: filing_id, stmt_seq, fact_seq, concept, value, label, is_total, is_abstract, period_end. Abstract facts don't count. Of several
    totals of a concept the last counts; the label is the concept where there is none; period_end is the first that a fact of the statement has.
    """
    real = facts.filter(~F.coalesce("is_abstract", F.lit(False)))
    period = real.filter(F.coalesce("period_end", F.lit("")) != "").groupBy("filing_id", "stmt_seq").agg(F.min_by("period_end", "fact_seq").alias("period_end"))
    last = F.max_by(F.struct("value", F.coalesce("label", "concept").alias("label")), "fact_seq").alias("t")
    totals = real.filter("is_total").groupBy("filing_id", "stmt_seq", "concept").agg(last)
    return totals.join(period, ["filing_id", "stmt_seq"], "left").select("filing_id", "stmt_seq", "concept", "t.value", "t.label", F.coalesce("period_end", F.lit("")).alias("period_end"))


def catalog(networks: DataFrame) -> DataFrame:
    """Counts by category, by statement type and by confidence, in one pass: filing_id, facet, name, n."""
    g = networks.groupingSets([["filing_id", "category"], ["filing_id", "statement_type"], ["filing_id", "confidence"]], "filing_id", "category", "statement_type", "confidence").agg(
        F.count("*").alias("n"), F.grouping("category").alias("gc"), F.grouping("statement_type").alias("gt")
    )
    facet = F.when(F.col("gc") == 0, "category").when(F.col("gt") == 0, "statement_type").otherwise("confidence")
    return g.select("filing_id", facet.alias("facet"), F.coalesce(F.when(facet == "category", F.col("category")).when(facet == "statement_type", F.col("statement_type")).otherwise(F.col("confidence")), F.lit("")).alias("name"), "n")


def report(scores: DataFrame, failed: DataFrame) -> DataFrame:
    """One JSON text a filing: its scores and its gravest failed checks."""
    f = failed.groupBy("filing_id").agg(F.array_sort(F.collect_list(F.struct("place", "check_name", "severity"))).alias("issues"))
    cols = [c for c in scores.columns if c != "filing_id"]
    return scores.join(f, "filing_id", "left").select("filing_id", F.to_json(F.struct(*cols, F.coalesce("issues", F.array().cast(f.schema["issues"].dataType)).alias("issues"))).alias("report"))


def text_summary(scores: DataFrame) -> DataFrame:
    """A line of text for each filing."""
    return scores.select("filing_id", F.format_string("%s: score %.1f, %s, %d critical, %d warning", F.col("filing_id").cast("string"), "overall_score", "level", "n_critical", "n_warning").alias("value"))
