"""Summaries of filings and catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Order of core statements in a catalog.
STATEMENT_ORDER = ("BALANCE_SHEET", "INCOME_STATEMENT", "CASH_FLOW", "EQUITY", "OTHER")
#: Facts of a filing that its main taxonomy is told by, and those that its characteristics are looked for in.
FIRST_FACTS, FIRST_VALUES = 100, 200


def fact_summary(facts: DataFrame) -> DataFrame:
    """One row a filing: counts of facts, of monetary, numeric and nil ones and of footnotes, and the span of periods.

    facts: filing_id, unit, is_numeric, is_nil, is_footnote, period_start, period_end.
    """
    monetary = F.coalesce(F.lower("unit").rlike("usd|eur|gbp|iso4217"), F.lit(False))
    return facts.groupBy("filing_id").agg(
        F.count("*").alias("n_facts"), F.count_if(monetary).alias("n_monetary"), F.count_if("is_numeric").alias("n_numeric"), F.count_if("is_nil").alias("n_nil"), F.count_if("is_footnote").alias("n_footnotes"),
        F.min(F.coalesce("period_start", "period_end")).alias("first_date"), F.max("period_end").alias("last_date"),
    )


def mixed_units(facts: DataFrame) -> DataFrame:
    """Concepts that a filing reports in several units, with these."""
    return facts.filter(F.col("unit").isNotNull()).groupBy("filing_id", "concept").agg(F.array_sort(F.collect_set("unit")).alias("units")).filter(F.size("units") > 1)


def primary_prefix(facts: DataFrame, first: int = FIRST_FACTS) -> DataFrame:
    """The most common prefix among each filing's first facts (fact_seq from 1), the one seen first of equally common ones."""
    p = facts.filter((F.col("fact_seq") <= first) & F.col("concept").contains(":")).withColumn("prefix", F.substring_index("concept", ":", 1))
    counts = p.groupBy("filing_id", "prefix").agg(F.count("*").alias("n"), F.min("fact_seq").alias("seen"))
    return counts.groupBy("filing_id").agg(F.max_by("prefix", F.struct("n", -F.col("seen"))).alias("prefix"), F.max("n").alias("n"))


def characteristic(filings: DataFrame, facts: DataFrame, keys: list[str], concepts: list[str], first: int = FIRST_VALUES) -> DataFrame:
    """One property of each filing: the first of some metadata fields that is not empty, else the value of the first fact
    (of those up to ``first``) whose concept holds one of some names."""
    holds = F.lit(False)
    for c in concepts:
        holds = holds | F.lower("concept").contains(c.lower())
    found = facts.filter((F.col("fact_seq") <= first) & holds & F.col("value").isNotNull()).groupBy("filing_id").agg(F.min_by("value", "fact_seq").alias("from_facts"))
    own = F.coalesce(*[F.nullif(F.col(k).cast("string"), F.lit("")) for k in keys])
    return filings.join(found, "filing_id", "left").select("filing_id", F.coalesce(own, "from_facts").alias("value"))


def metadata_row(facts: DataFrame, contexts: DataFrame, units: DataFrame) -> DataFrame:
    """How many facts, contexts and units each filing has."""
    n = lambda df, name: df.groupBy("filing_id").agg(F.count("*").alias(name))
    out = n(facts, "n_facts").join(n(contexts, "n_contexts"), "filing_id", "full_outer").join(n(units, "n_units"), "filing_id", "full_outer")
    return out.fillna(0)


def extension_facts(facts: DataFrame, standard: Column) -> DataFrame:
    """Facts with a prefix whose namespace is not standard. standard: a condition on the columns of facts."""
    return facts.filter(F.col("concept").contains(":") & ~F.coalesce(standard, F.lit(False)))


def organised(networks: DataFrame, by: str, name: str) -> DataFrame:
    """by, name, n, share: how often each name occurs in a category or type, and its share of it in percent; a row for each, whatever their number."""
    counts = networks.groupBy(by, name).agg(F.count("*").alias("n"))
    whole = networks.groupBy(by).agg(F.count("*").alias("all"))
    return counts.join(whole, counts[by].eqNullSafe(whole[by])).select(counts[by], name, "n", F.round(100.0 * F.col("n") / F.col("all"), 2).alias("share"))


def concept_roles(placements: DataFrame) -> DataFrame:
    """concept, role, n: the roles that each concept appears in and how often, a row for each, whatever their number."""
    return placements.groupBy("concept", "role").agg(F.count("*").alias("n"))


def core_statements(networks: DataFrame) -> DataFrame:
    """Core statements of each filing, numbered in the usual order of their kinds and then by role."""
    kinds = F.array(*[F.lit(k) for k in STATEMENT_ORDER])
    rank = F.coalesce(F.nullif(F.array_position(kinds, F.col("statement_type")), F.lit(0)), F.lit(len(STATEMENT_ORDER)))
    place = F.row_number().over(Window.partitionBy("filing_id").orderBy(rank, "role"))
    return networks.filter("category = 'CORE_STATEMENT'").select("filing_id", "role", "statement_type", place.alias("place"))


def data_quality(facts: DataFrame) -> DataFrame:
    """Shares of facts with a value and with a period; a filing is sound from half and from nine tenths on."""
    share = lambda c: F.avg(F.col(c).isNotNull().cast("double"))
    out = facts.groupBy("filing_id").agg(share("value").alias("value_share"), share("period_end").alias("period_share"))
    return out.withColumn("sound", (F.col("value_share") >= 0.5) & (F.col("period_share") >= 0.9))


def missing_concepts(facts: DataFrame, required: list[str]) -> DataFrame:
    """Required names that no concept of a filing holds, whatever the case."""
    flags = [F.max(F.lower("concept").contains(r.lower())).alias(f"_{i}") for i, r in enumerate(required)]
    lack = F.array_compact(F.array(*[F.when(~F.col(f"_{i}"), r) for i, r in enumerate(required)]))
    return facts.groupBy("filing_id").agg(*flags).select("filing_id", F.explode(lack).alias("missing"))


def batch_totals(reports: DataFrame) -> DataFrame:
    """Totals of a batch of validation reports: files, valid ones, errors and warnings."""
    return reports.agg(F.count("*").alias("n_files"), F.count_if("is_valid").alias("n_valid"), F.sum("n_errors").alias("n_errors"), F.sum("n_warnings").alias("n_warnings"))


def european_main(statements: DataFrame, name: Column, slot: Column) -> DataFrame:
    """filing_id, slot, name: the main statement of each slot, of several the last (by stmt_seq)."""
    named = statements.withColumn("_name", name).withColumn("slot", slot).filter("slot is not null")
    return named.groupBy("filing_id", "slot").agg(F.max_by("_name", "stmt_seq").alias("name"))


def filing_text(info: DataFrame, summary: DataFrame, top: DataFrame) -> DataFrame:
    """A text of lines for each filing: what it is, how much it holds, its commonest concepts.

    info: filing_id, company, form, date, of which missing ones show as N/A. summary: filing_id, n_facts, n_monetary, n_nil. top: filing_id, place, concept, n.
    Lines without a count are left out.
    """
    line = lambda label, value: F.concat(F.lit(f"{label}: "), value)
    share = lambda n: F.concat(F.format_number(n, 0), F.lit(" ("), F.round(F.try_divide(100.0 * n, F.col("n_facts")), 0).cast("int").cast("string"), F.lit("%)"))
    concepts = top.groupBy("filing_id").agg(F.array_sort(F.collect_list(F.struct("place", "concept", "n"))).alias("top"))
    rows = info.join(summary, "filing_id").join(concepts, "filing_id", "left")
    shown = F.transform(F.coalesce("top", F.array().cast(concepts.schema["top"].dataType)), lambda t: F.concat(F.lit("  "), t["concept"], F.lit(": "), t["n"].cast("string")))
    head = [line("Filing", F.col("filing_id").cast("string")), *[line(label, F.coalesce(F.col(c).cast("string"), F.lit("N/A"))) for label, c in (("Company", "company"), ("Form", "form"), ("Date", "date"))], line("Facts", F.format_number("n_facts", 0))]
    more = [F.when(F.col(c) > 0, line(label, share(F.col(c)))) for label, c in (("Monetary", "n_monetary"), ("Nil", "n_nil"))]
    return rows.select("filing_id", F.array_join(F.concat(F.array_compact(F.array(*head, *more)), shown), "\n").alias("text"))


def parsed_json(info: DataFrame, facts: DataFrame) -> DataFrame:
    """filing_id, part, json: a filing as JSON texts, its metadata as part 0, then its facts (filing_id, fact_seq, ...), a thousand each.

    The parts of a filing of any size are bounded, and a reader that takes them in order has the whole.
    """
    own = [c for c in facts.columns if c not in ("filing_id", "fact_seq")]
    chunks = facts.withColumn("part", (F.floor((F.col("fact_seq") - 1) / 1000) + 1).cast("long")).groupBy("filing_id", "part").agg(F.array_sort(F.collect_list(F.struct("fact_seq", *own))).alias("facts"))
    head = info.select("filing_id", F.lit(0).cast("long").alias("part"), F.to_json(F.struct(F.struct(*[c for c in info.columns if c != "filing_id"]).alias("metadata"))).alias("json"))
    return head.unionByName(chunks.select("filing_id", "part", F.to_json(F.struct("facts")).alias("json")))
