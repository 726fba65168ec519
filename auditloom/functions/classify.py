"""Classification of networks, statements and results as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of role URIs that exclude a network from the core, by category in order of trial.
CATEGORY_PARTS = (
    ("DOCUMENT", ("DocumentAndEntityInformation", "CoverPage", "Document", "Cover")),
    ("PARENTHETICAL", ("Parenthetical",)),
    ("DETAIL", ("Details", "Schedule", "Schedules", "Narrative")),
    ("TABLE", ("Tables", "Tabular")),
    ("POLICY", ("Policies", "AccountingPolicies", "SignificantAccountingPolicies")),
)
# Parts of role URIs that tell the kind of statement, in order of trial.
STATEMENT_PARTS = (
    ("BALANCE_SHEET", ("FinancialPosition", "BalanceSheet", "BalanceSheets", "StatementOfFinancialPosition", "Property", "Equipment", "Asset", "Liability", "Inventory", "Investment", "Debt", "Payable", "Receivable", "Goodwill", "Intangible")),
    ("INCOME_STATEMENT", ("Income", "Operations", "Comprehensive", "EarningsStatement", "ProfitAndLoss", "StatementOfIncome", "StatementOfOperations", "Revenue", "Sales", "Expense", "Cost", "Earning")),
    ("CASH_FLOW", ("CashFlow", "CashFlows", "StatementOfCashFlow")),
    ("EQUITY", ("Equity", "Stockholders", "Shareholders", "ChangesInEquity", "StatementOfStockholdersEquity", "StatementOfShareholdersEquity")),
)
# Limits of the structure that a core statement has.
MIN_FACTS, MAX_DEPTH, MIN_ROOTS, CORE_SCORE = 15, 6, 1, 2
# Parts of file names that are not main statements, and limits of main ones.
NOT_MAIN = ("parenthetical", "details", "policies", "tables", "disclosure", "schedule", "coverpage", "cover", "audit", "insider", "pvp", "err", "award", "trading")
MAIN_BYTES, MAIN_FACTS = 40_000, 50
# Failures of downloads by what they call for, and attempts after which another address is tried.
URL_FAILURES = ("invalid_url", "url_404", "url_403", "dns_error")
TEMPORARY_FAILURES = ("network_error", "timeout", "incomplete_download")
EXTRACTION_FAILURES = ("corrupted_zip", "invalid_archive")
SYSTEM_FAILURES = ("permission_denied", "disk_full", "extraction_error")
MAX_DOWNLOADS, MAX_EXTRACTIONS = 3, 2


def first_part(text: Column, table: tuple, otherwise: str) -> Column:
    """The first name in the table one of whose parts occurs in the text, whatever the case."""
    t = F.lower(text)
    any_of = lambda parts: reduce(lambda a, b: a | b, (t.contains(p.lower()) for p in parts))
    return reduce(lambda acc, row: acc.when(any_of(row[1]), row[0]), table, F).otherwise(otherwise)


def structure_score(facts: Column, depth: Column, roots: Column) -> Column:
    return (facts >= MIN_FACTS).cast("int") + (depth <= MAX_DEPTH).cast("int") + (roots >= MIN_ROOTS).cast("int")


def network_category(role: Column, facts: Column, depth: Column, roots: Column) -> Column:
    """By parts of the role URI; where none excludes it, a core statement if two of three structural signs hold."""
    by_name = first_part(role, CATEGORY_PARTS, "")
    return F.when(by_name != "", by_name).when(structure_score(facts, depth, roots) >= CORE_SCORE, "CORE_STATEMENT").otherwise("UNKNOWN")


def statement_type(role: Column) -> Column:
    return first_part(role, STATEMENT_PARTS, "OTHER")


def is_main_statement(name: Column, size: Column, facts: Column) -> Column:
    """Large, with many facts, called consolidated or combined, and not of an excluded kind."""
    t = F.lower(name)
    excluded = reduce(lambda a, b: a | b, (t.contains(x) for x in NOT_MAIN))
    return (size >= MAIN_BYTES) & (facts >= MAIN_FACTS) & (t.contains("consolidated") | t.contains("combined")) & ~excluded


def slot_of(name: Column) -> Column:
    """The statement that a file's name stands for, or null."""
    t = F.lower(name)
    return (
        F.when(t.contains("balance") | t.contains("financialposition"), "balance_sheet").when(t.contains("cashflow") | t.contains("cash_flow"), "cash_flow")
        .when(t.contains("equity") | t.contains("stockholders") | t.contains("shareholders"), "equity").when(t.contains("comprehensive"), "comprehensive_income")
        .when(t.contains("income") | t.contains("operations") | t.contains("earnings"), "income_statement")
    )


def retry_strategy(reason: Column, downloads: Column, extractions: Column) -> Column:
    """What to do after a failed download. Where the system is at fault, a person must act."""
    downloading = reason.isin(*URL_FAILURES, *TEMPORARY_FAILURES) & (downloads >= MAX_DOWNLOADS)
    extracting = reason.isin(*EXTRACTION_FAILURES) & (extractions >= MAX_EXTRACTIONS)
    return F.when(reason.isin(*SYSTEM_FAILURES), "manual_intervention").when(downloading | extracting, "try_alternative_url").otherwise("retry_same_url")


def quality_level(score: Column, criticals: Column, horizontal: Column, vertical: Column) -> Column:
    """By thresholds 90, 75, 50 and 25. A critical issue caps at GOOD, two cap GOOD at FAIR, so does a low H or V score."""
    level = F.when(score >= 90, "EXCELLENT").when(score >= 75, "GOOD").when(score >= 50, "FAIR").when(score >= 25, "POOR").otherwise("UNUSABLE")
    level = F.when((criticals > 0) & (level == "EXCELLENT"), "GOOD").when((criticals >= 2) & (level == "GOOD"), "FAIR").otherwise(level)
    return F.when(((horizontal < 50) | (vertical < 50)) & level.isin("EXCELLENT", "GOOD"), "FAIR").otherwise(level)


def confidence(score: Column, parts: list[Column], checks: Column) -> Column:
    """1, less 0.15 for each threshold nearer than 5, 0.2 if the parts differ much, 0.15 for under 5 checks; 0 at least."""
    near = reduce(lambda a, b: a + b, ((F.abs(score - t) < 5).cast("int") for t in (90, 75, 50, 25)))
    mean = reduce(lambda a, b: a + b, parts) / len(parts)
    spread = reduce(lambda a, b: a + b, ((p - mean) * (p - mean) for p in parts)) / len(parts)
    return F.greatest(F.lit(0.0), 1.0 - 0.15 * near - 0.2 * (spread > 400).cast("int") - 0.15 * (checks < 5).cast("int"))


def coverage_level(percent: Column) -> Column:
    return F.when(percent >= 100, "complete").when(percent >= 98, "excellent").when(percent >= 95, "good").when(percent >= 90, "acceptable").when(percent >= 85, "marginal").otherwise("poor")


def period_type_of(instant: Column, start: Column, end: Column) -> Column:
    return F.when(instant.isNotNull(), "instant").when(start.isNotNull() & end.isNotNull(), "duration").otherwise("forever")


def market_of(url: Column) -> Column:
    t = F.lower(url)
    return F.when(t.rlike(r"sec\.gov"), "sec").when(t.rlike(r"company-information\.service\.gov\.uk|companieshouse"), "uk").when(t.rlike(r"filings\.xbrl\.org|esma\.europa\.eu"), "esef").otherwise("unknown")


def http_severity(status: Column) -> Column:
    return F.when(status < 400, "ok").when(status.isin(408, 425, 429) | (status >= 500), "temporary").otherwise("permanent")
