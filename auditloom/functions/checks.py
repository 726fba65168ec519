"""Predicates and validations of facts, contexts, filings and search results, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditloom.functions import names, numbers, periods

# Kinds of periods, the first year of filings, attempts after which a download is given up, states of a usable library.
PERIOD_KINDS, FOUNDED, MAX_ATTEMPTS, AVAILABLE = ("instant", "duration", "forever"), 1934, 6, ("completed", "ready")
# Decimals beyond which a number is oddly precise, and the most that a checked display value may differ.
MOST_DECIMALS, DISPLAY_GAP = 6, 0.01
# Beginnings, ends and parts of concept names that tell the sign, negative ones first.
NEGATIVE = ("^Payments?", "^Repayments?", "Expense$", "Cost$", "Loss$", "^Decrease", "Outflow", "^Use[ds]?")
POSITIVE = ("^Proceeds?", "^Revenue", "^Income", "^Gain", "^Increase", "Inflow", "^Provide[ds]?")
# Grades of mapped filings.
GRADES = ((90, "EXCELLENT"), (80, "GOOD"), (70, "ACCEPTABLE"), (60, "POOR"), (50, "MINIMUM"))
# Words of a role's definition by category and by statement, in order of trial.
CORE_WORDS, NOT_CORE = ("statement", "sheet", "consolidated"), ("detail", "schedule", "table")
OTHER_WORDS = (("DETAIL", ("detail", "schedule")), ("TABLE", ("table",)), ("POLICY", ("polic",)))
DEFINITION_TYPES = (
    ("BALANCE_SHEET", ("balance sheet", "financial position", "balance sheets")),
    ("INCOME_STATEMENT", ("income", "operations", "earnings", "profit", "loss")),
    ("CASH_FLOW", ("cash flow",)),
    ("EQUITY", ("equity", "stockholders", "shareholders", "capital")),
)
SIMPLE_TYPES = (
    ("balance_sheet", ("balance", "position")), ("income_statement", ("income", "operations", "profit")), ("cash_flow", ("cash",)),
    ("equity", ("equity", "stockholder")), ("comprehensive_income", ("comprehensive",)),
)
# Names of the main statements under the European format, and other names of them.
EUROPEAN_MAIN = ("statementoffinancialposition", "profitorloss", "statementofcashflows", "statementofchangesinequity", "statementofcomprehensiveincome", "notesandmandatoryitems")
EUROPEAN_OTHER = (
    "balancesheet", "consolidatedbalancesheet", "incomestatement", "profitandloss", "cashflowstatement", "equitystatement", "comprehensiveincome", "othercomprehensiveincome", "notes",
)


def _some(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("")) != ""


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(p) for p in parts))


def _errors(*found: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, message) for cond, message in found]))


def fact_errors(name: Column, value: Column, context: Column, unit: Column, numeric: Column) -> Column:
    """What a fact lacks: name, value, context, and the unit of a numeric one."""
    return _errors((~_some(name), "missing name"), (value.isNull(), "missing value"), (~_some(context), "missing context"), (numeric & ~_some(unit), "missing unit"))


def context_errors(context_id: Column, entity: Column, kind: Column, instant: Column, start: Column, end: Column) -> Column:
    """What a context lacks, by the kind of its period, and a start after its end."""
    duration = F.coalesce(kind == "duration", F.lit(False))
    return _errors(
        (~_some(context_id), "missing id"), (~_some(entity), "missing entity"), (~_some(kind), "missing kind"), (F.coalesce(kind == "instant", F.lit(False)) & instant.isNull(), "missing instant"),
        (duration & start.isNull(), "missing start"), (duration & end.isNull(), "missing end"), (duration & F.coalesce(start > end, F.lit(False)), "start after end"),
    )


def dates_consistent(start: Column, end: Column) -> Column:
    """A period that has both ends begins before it ends."""
    return F.coalesce(start < end, F.lit(True))


def period_type_valid(concept_kind: Column, context_kind: Column) -> Column:
    """Instant concepts have instant contexts and duration ones duration contexts; null where a kind is unknown."""
    return F.when(concept_kind.isin(*PERIOD_KINDS) & context_kind.isin(*PERIOD_KINDS), concept_kind == context_kind)


def date_valid(d: Column, today: Column) -> Column:
    return F.coalesce((F.year(d) >= FOUNDED) & (d <= today), F.lit(False))


def in_date_range(text: Column, start: str | None = None, end: str | None = None) -> Column:
    """ISO dates within the range, both ends included; what is no date stays."""
    d = F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
    inside = F.lit(True)
    if start:
        inside = inside & (d >= F.lit(start).cast("date"))
    if end:
        inside = inside & (d <= F.lit(end).cast("date"))
    return F.coalesce(inside, F.lit(True)) | d.isNull()


def too_precise(decimals: Column) -> Column:
    return F.coalesce(decimals > MOST_DECIMALS, F.lit(False))


def value_within(value: Column, low: float, high: float) -> Column:
    return F.coalesce(value.between(low, high), F.lit(False))


def ready_for_extraction(download: Column, extraction: Column) -> Column:
    return F.coalesce((download == "completed") & (extraction == "pending"), F.lit(False))


def ready_for_parsing(files_exist: Column, instance_path: Column, instance_exists: Column) -> Column:
    return F.coalesce(files_exist, F.lit(False)) & _some(instance_path) & F.coalesce(instance_exists, F.lit(False))


def library_available(status: Column, total_files: Column, files_exist: Column) -> Column:
    """Catalog says that the library is there with files, and the disk agrees."""
    return F.coalesce(status.isin(*AVAILABLE) & (total_files > 0) & files_exist, F.lit(False))


def needs_retry(status: Column, attempts: Column) -> Column:
    return F.coalesce((status == "failed") & (attempts < MAX_ATTEMPTS), F.lit(False))


def failed_for_good(status: Column, attempts: Column) -> Column:
    return F.coalesce((status == "failed") & (attempts >= MAX_ATTEMPTS), F.lit(False))


def arc_valid(parent: Column, parts: Column, weights: Column) -> Column:
    """The weighted sum of an array of values equals the parent exactly (no tolerance), in decimals of two places."""
    total = F.aggregate(F.zip_with(parts, weights, lambda v, w: (v * w).cast("decimal(28,2)")), F.lit(0).cast("decimal(38,2)"), lambda a, x: (a + x).cast("decimal(38,2)"))
    return total == parent.cast("decimal(38,2)")


def display_valid(value: Column, decimals: Column, shown: Column) -> Column:
    """A display value is the value scaled by its decimals; without decimals, the value itself."""
    return F.when(decimals.isNull(), value == shown).otherwise(F.abs(numbers.scale_by_decimals(value, decimals) - shown) < DISPLAY_GAP)


def sign_of_name(concept: Column) -> Column:
    """-1 or 1, as the last part of a concept's name suggests; else null."""
    local = F.substring_index(F.substring_index(concept, ":", -1), "_", -1)
    return F.when(local.rlike("(?i)" + "|".join(NEGATIVE)), -1).when(local.rlike("(?i)" + "|".join(POSITIVE)), 1)


def grade(score: Column) -> Column:
    out = F
    for least, name in GRADES:
        out = out.when(score >= least, name)
    return out.otherwise("UNACCEPTABLE")


def period_end_text(c: Column) -> Column:
    """A date as it stands without its time, fit for a folder name; null for nothing."""
    t = F.substring_index(names.strip(c.cast("string")), "T", 1)
    return F.nullif(F.translate(t, "/\\:", "---"), F.lit(""))


def definition_category(definition: Column) -> Column:
    t = F.lower(definition)
    out = F.when(_any(t, CORE_WORDS), F.when(_any(t, NOT_CORE), "UNKNOWN").otherwise("CORE_STATEMENT"))
    for name, parts in OTHER_WORDS:
        out = out.when(_any(t, parts), name)
    return out.otherwise("UNKNOWN")


def _first(text: Column, table: tuple, otherwise: str) -> Column:
    return reduce(lambda acc, row: acc.when(_any(text, row[1]), row[0]), table, F).otherwise(otherwise)


def definition_type(definition: Column) -> Column:
    return _first(F.lower(definition), DEFINITION_TYPES, "OTHER")


def simple_type(name: Column, role: Column) -> Column:
    """The kind of statement that name and role speak of."""
    return _first(F.concat_ws(" ", F.lower(name), F.lower(role)), SIMPLE_TYPES, "other")


def network_confidence(any_pattern: Column, structure: Column, category: Column) -> Column:
    """HIGH from 0.8 and MEDIUM from 0.5 of 0.3 for a pattern, half the share of structural signs (of 3) and 0.2 for a category."""
    score = F.round(0.3 * any_pattern.cast("int") + 0.5 * structure / 3 + 0.2 * (category != "UNKNOWN").cast("int"), 9)
    return F.when(score >= 0.8, "HIGH").when(score >= 0.5, "MEDIUM").otherwise("LOW")


def european_category(name: Column) -> Column:
    key = names.statement_key(name)
    t = F.lower(name)
    return F.when(key.isin(*EUROPEAN_MAIN, *EUROPEAN_OTHER), "main").when(t.contains("detail"), "detail").when(t.contains("note"), "note").otherwise("other")


# Main statements of European filings by key, other keys that stand for them, and the slot that each fills.
EUROPEAN_SLOTS = {
    "statementoffinancialposition": "balance_sheet", "profitorloss": "income_statement", "statementofcashflows": "cash_flow", "statementofchangesinequity": "equity_statement",
    "statementofcomprehensiveincome": "comprehensive_income", "notesandmandatoryitems": "notes",
}
EUROPEAN_NAMES = {
    "balancesheet": "statementoffinancialposition", "consolidatedbalancesheet": "statementoffinancialposition", "incomestatement": "profitorloss", "profitandloss": "profitorloss", "cashflowstatement": "statementofcashflows",
    "equitystatement": "statementofchangesinequity", "comprehensiveincome": "statementofcomprehensiveincome", "othercomprehensiveincome": "statementofcomprehensiveincome", "notes": "notesandmandatoryitems",
}


def european_slot(name: Column) -> Column:
    """The main statement that a European statement's name stands for; null for others."""
    key = names.statement_key(name)
    table = lambda values: F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.try_element_at(table(EUROPEAN_SLOTS), F.coalesce(F.try_element_at(table(EUROPEAN_NAMES), key), key))


def is_default_member(member: Column, default: Column, domain: Column) -> Column:
    """No member, or one whose last part is that of the dimension's default or domain."""
    last = lambda c: names.canonical(F.substring_index(F.substring_index(c, ":", -1), "_", -1))
    return ~_some(member) | F.coalesce(last(member) == last(default), F.lit(False)) | F.coalesce(last(member) == last(domain), F.lit(False))


def is_namespace_map(values: Column) -> Column:
    """Over half of an array's values are web addresses."""
    uris = F.size(F.filter(values, lambda v: v.rlike("^https?://")))
    return F.coalesce(F.try_divide(uris.cast("double"), F.size(values)) > 0.5, F.lit(False))


def search_errors(company: Column, form: Column, start: Column, end: Column, most: Column) -> Column:
    """What is wrong with the parameters of a search."""
    d = lambda c: periods.date_or_null(c)
    return _errors(
        (names.uk_number(company).isNull(), "company number"), (~_some(form), "form"), (_some(start) & d(start).isNull(), "start"), (_some(end) & d(end).isNull(), "end"),
        (F.coalesce(d(start) > d(end), F.lit(False)), "range"), (F.coalesce(most < 1, F.lit(False)), "limit"),
    )


def download_url(package: Column, report: Column, base: str) -> Column:
    """The package's address, else the report's, made absolute."""
    url = F.coalesce(F.nullif(package, F.lit("")), F.nullif(report, F.lit("")))
    return F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit(base), url))


def download_errors(exists: Column, size: Column, name: Column, least: int = 1) -> Column:
    """What speaks against a downloaded file: missing, smaller than it may be, or no archive by its name."""
    return _errors((~F.coalesce(exists, F.lit(False)), "missing"), (F.coalesce(size, F.lit(0)) < least, "too small"), (~F.coalesce(F.lower(name).rlike(r"\.(zip|tar|tar\.gz|tgz)$"), F.lit(False)), "no archive"))
