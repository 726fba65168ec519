"""Names of concepts, forms, companies and identifiers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes of standard taxonomies, and the longest prefix that counts as a company's own.
KNOWN_PREFIXES = ("us-gaap", "usgaap", "ifrs-full", "ifrs", "dei", "srt", "country", "currency", "exch", "naics", "sic", "stpr", "invest", "ecd", "custom")
MAX_EXTENSION_PREFIX = 6

# Spellings of periodic forms.
FORM_ALIASES = {"10K": "10-K", "10-K": "10-K", "10Q": "10-Q", "10-Q": "10-Q", "8K": "8-K", "8-K": "8-K", "20F": "20-F", "20-F": "20-F", "40F": "40-F", "40-F": "40-F", "6K": "6-K", "6-K": "6-K"}
ANNUAL, QUARTERLY, CURRENT = ("10-K", "20-F", "40-F"), ("10-Q",), ("8-K", "6-K")


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def canonical(c: Column) -> Column:
    """Lower case without underscores, hyphens and spaces."""
    return F.translate(F.lower(c), "_- ", "")


def local_name(concept: Column) -> Column:
    """The part after the namespace prefix of ns:Name, ns_Name or {uri}Name.

    After a colon: what follows the last one. Before the first underscore: a prefix if it is a known one, or up to
    MAX_EXTENSION_PREFIX letters before a capital.
    """
    head = F.lower(F.substring_index(concept, "_", 1))
    rest = F.regexp_replace(concept, "^[^_]*_", "")
    own = head.rlike(f"^[a-z]{{1,{MAX_EXTENSION_PREFIX}}}$") & rest.rlike("^[A-Z]")
    return (
        F.when(concept.isNull() | (concept == ""), F.lit(""))
        .when(concept.startswith("{"), F.regexp_replace(concept, r"^\{[^}]*\}", ""))
        .when(concept.contains(":"), F.substring_index(concept, ":", -1))
        .when(concept.contains("_") & (head.isin(*KNOWN_PREFIXES) | own), rest)
        .otherwise(concept)
    )


def concept_key(concept: Column) -> Column:
    """The key on which spellings of one concept meet."""
    return canonical(local_name(concept))


def qname(c: Column) -> Column:
    """Struct of namespace, prefix and local name of {uri}Name, prefix:Name or prefix_Name (capital after it)."""
    clark, colon, bar = r"^\{([^}]*)\}(.*)$", r"^([^:]*):(.*)$", r"^([A-Za-z][\w-]*?)_([A-Z].*)$"
    some = lambda pattern, group: F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))
    return F.struct(
        some(clark, 1).alias("namespace"),
        F.when(~c.startswith("{"), F.coalesce(some(colon, 1), F.when(~c.contains(":"), some(bar, 1)))).alias("prefix"),
        F.when(c.startswith("{"), some(clark, 2)).when(c.contains(":"), some(colon, 2)).otherwise(F.coalesce(some(bar, 2), c)).alias("local"),
    )


def resolve(c: Column, namespaces: Column) -> Column:
    """{uri}Name of prefix:Name by a map of prefixes; null where the prefix is unknown."""
    return F.concat(F.lit("{"), F.try_element_at(namespaces, F.substring_index(c, ":", 1)), F.lit("}"), F.substring_index(c, ":", -1))


def namespace_of(c: Column) -> Column:
    """What stands before the last colon; empty without one."""
    return F.regexp_extract(c, "^(.*):([^:]*)$", 1)


def href_concept(href: Column) -> Column:
    """The concept that a locator's fragment names: what follows #, its first underscore as a colon."""
    return F.regexp_replace(F.substring_index(href, "#", -1), "^([^_:]+)_", "$1:")


def last_segment(uri: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(uri, "/+$", ""), "/"), -1)


def same_role(a: Column, b: Column, strict: bool = False) -> Column:
    """Roles are equal, or (unless strict) their last segments are, whatever the case."""
    return (a == b) if strict else (a == b) | (F.lower(last_segment(a)) == F.lower(last_segment(b)))


def safe_name(c: Column, most: int = 100) -> Column:
    """Fit for a folder: other characters than letters, digits, dot and hyphen become one underscore each run."""
    return F.substring(F.regexp_replace(F.regexp_replace(c, r"[^\w.\-]+", "_"), "^_+|_+$", ""), 1, most)


def cik(c: Column) -> Column:
    """Ten digits with leading zeros; null for what is not a number of up to ten digits."""
    t = strip(c.cast("string"))
    return F.when(t.rlike(r"^\d{1,10}$"), F.lpad(t, 10, "0"))


def identifier_type(c: Column) -> Column:
    t = strip(c)
    return F.when(t.rlike(r"^\d{1,10}$"), "cik").when(t.rlike(r"^[A-Za-z]{1,5}([.-][A-Za-z]{1,2})?$"), "ticker").when(t.rlike("^[A-Z0-9]{20}$"), "lei").otherwise("name")


def is_accession(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\d{10}-\d{2}-\d{6}$"), F.lit(False))


def is_lei(c: Column) -> Column:
    return F.coalesce(c.rlike("^[A-Z0-9]{20}$"), F.lit(False))


def uk_number(c: Column) -> Column:
    """A UK company number in eight characters, or null: digits alone are filled up, two letters may lead."""
    t = F.regexp_replace(F.upper(c), r"\s+", "")
    return F.when(t.rlike(r"^\d{1,8}$"), F.lpad(t, 8, "0")).when(t.rlike(r"^[A-Z]{2}\d{6}$"), t)


def uk_jurisdiction(number: Column) -> Column:
    return F.when(number.rlike("^S[CLO]"), "scotland").when(number.rlike("^N[ICL]|^R0"), "northern-ireland").when(number.isNotNull(), "england-wales")


def form(c: Column) -> Column:
    """The usual spelling of a form: known aliases without regard to case, others in capitals; /A stays."""
    t = F.upper(strip(c))
    base = F.regexp_replace(t, "/A$", "")
    known = F.create_map(*[F.lit(x) for pair in FORM_ALIASES.items() for x in pair])
    return F.concat(F.coalesce(F.try_element_at(known, base), base), F.when(t.endswith("/A"), "/A").otherwise(""))


def form_category(c: Column) -> Column:
    base = F.regexp_replace(form(c), "/A$", "")
    return F.when(base.isin(*ANNUAL), "annual").when(base.isin(*QUARTERLY), "quarterly").when(base.isin(*CURRENT), "current").otherwise("other")


def display(v: Column) -> Column:
    """$1,234 and ($1,234) for negatives, rounded half-even to a whole number."""
    text = F.concat(F.lit("$"), F.format_number(F.bround(F.abs(v), 0), 0))
    return F.when(v < 0, F.concat(F.lit("("), text, F.lit(")"))).otherwise(text)


def dimension_signature(dims: Column) -> Column:
    """d=m pairs of a map in order of d, joined by commas; empty for none."""
    pairs = F.transform(F.array_sort(F.map_entries(dims)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.coalesce(F.array_join(pairs, ","), F.lit(""))


# Spellings of forms in file and folder names, by form.
FORM_SPELLINGS = {
    "10-k": ("10-k", "10_k", "10k", "form10k", "form10-k", "form 10-k", "annual"),
    "10-q": ("10-q", "10_q", "10q", "form10q", "form10-q", "form 10-q", "quarterly"),
    "8-k": ("8-k", "8_k", "8k", "form8k", "form8-k", "form 8-k", "current"),
    "20-f": ("20-f", "20_f", "20f", "form20f", "form20-f", "form 20-f"),
    "40-f": ("40-f", "40_f", "40f", "form40f", "form40-f", "form 40-f"),
    "6-k": ("6-k", "6_k", "6k", "form6k", "form6-k", "form 6-k"),
    "afr": ("afr", "annual-financial-report", "annual_financial_report"),
    "hyr": ("hyr", "half-year-report", "half_year_report", "interim"),
    "annual": ("annual", "annual-report", "annual_report", "ar"),
}
# Parts of namespace addresses by taxonomy, in order of trial.
TAXONOMY_PARTS = (
    ("us-gaap", ("us-gaap", "fasb.org/us-gaap")), ("ifrs", ("ifrs", "iasb")), ("uk-gaap", ("uk-gaap", "frc.org.uk")), ("esef", ("esef", "esma")),
    ("dei", ("dei", "xbrl.sec.gov/dei")), ("srt", ("srt", "fasb.org/srt")),
)
# Kinds of relationships and where their addresses lie.
ARCROLES = {
    "http://www.xbrl.org/2003/arcrole/": ("parent-child", "summation-item", "general-special", "essence-alias", "similar-tuples", "requires-element"),
    "http://xbrl.org/int/dim/arcrole/": ("hypercube-dimension", "dimension-domain", "domain-member", "dimension-default", "all", "notAll"),
}
# Ends of statement names that do not tell statements apart.
STATEMENT_ENDS = ("parenthetical", "details", "policies", "tables", "_parenthetical", "_details", "_policies", "_tables")


# What users call the reports of European issuers, without spaces and hyphens.
EUROPEAN_FORMS = {
    "annual": "AFR", "afr": "AFR", "yearly": "AFR", "10k": "AFR", "semiannual": "SFR", "sfr": "SFR", "halfyear": "SFR", "interim": "IFR", "ifr": "IFR", "quarterly": "QFR", "qfr": "QFR", "10q": "QFR",
}


def european_form(c: Column) -> Column:
    """The kind of report that a European form's name means; other names in capitals."""
    t = strip(c)
    known = F.create_map(*[F.lit(x) for pair in EUROPEAN_FORMS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.translate(F.lower(t), " -", "")), F.upper(t))


def last_part_key(concept: Column) -> Column:
    """The variant of concept_key that cuts after the last colon and then after the last underscore."""
    return canonical(F.substring_index(F.substring_index(F.coalesce(concept, F.lit("")), ":", -1), "_", -1))


def form_variations(form_: Column) -> Column:
    """Spellings under which a form may be found, each once whatever the case: as given, with other signs, and known ones."""
    low = F.lower(form_)
    plain = F.regexp_replace(low, "_", "-")
    known = F
    for name, words in FORM_SPELLINGS.items():
        known = known.when((low == name) | (plain == name) | low.isin(*words), F.array(*map(F.lit, words)))
    known = known.otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(low, plain, F.translate(plain, "-", "_"), F.translate(plain, "-", "")), known))


def local_names_match(a: Column, b: Column) -> Column:
    return F.coalesce(qname(a)["local"] == qname(b)["local"], F.lit(False))


def replace_namespace(c: Column, namespace: Column) -> Column:
    return F.concat(F.lit("{"), namespace, F.lit("}"), qname(c)["local"])


def namespace_uri(c: Column) -> Column:
    """Without white space around and slashes at the end."""
    return F.regexp_replace(strip(c), "/+$", "")


def statement_name(path: Column) -> Column:
    """A statement's name from its file: no folders, no extension, words with capitals."""
    return F.initcap(F.translate(F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", ""), "_-", "  "))


def statement_key(name: Column) -> Column:
    """Lower case without signs, and without ends that do not tell statements apart, taken off in order."""
    t = F.lower(name)
    for end in STATEMENT_ENDS:
        t = F.regexp_replace(t, end + r"\z", "")
    return F.translate(t, "_-", "")


def taxonomy_of(uri: Column) -> Column:
    """The taxonomy that an address speaks of, else its last segment."""
    t, out = F.lower(uri), F
    for name, parts in TAXONOMY_PARTS:
        for p in parts:
            out = out.when(t.contains(p), name)
    return out.otherwise(last_segment(uri))


def form_of_path(path: Column, otherwise: Column) -> Column:
    """The folder after "filings" in a path, else another."""
    parts = F.split(path, "/")
    return F.coalesce(F.when(F.array_contains(parts, "filings"), F.get(parts, F.array_position(parts, "filings").cast("int"))), otherwise)


def arcrole_name(uri: Column) -> Column:
    """The name of a standard relationship; others stay as they are."""
    known = [base + n for base, kinds in ARCROLES.items() for n in kinds]
    return F.when(uri.isin(*known), F.substring_index(uri, "/", -1)).otherwise(uri)


def arcrole_uri(name: Column) -> Column:
    """The address of a standard relationship; null for other names."""
    out = F
    for base, kinds in ARCROLES.items():
        out = out.when(name.isin(*kinds), F.concat(F.lit(base), name))
    return out.otherwise(F.lit(None).cast("string"))
