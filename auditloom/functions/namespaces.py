"""Namespaces of taxonomies recognised by the form of their address, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forms of namespaces in order of trial (authority, taxonomy and version are the groups), where their files lie,
# addresses to try in place of those, spellings of authorities, markets by authority, namespaces that name no taxonomy.
PATTERNS = (
    (r"https?://xbrl\.([^/]+)/([^/]+)/(\d{4})", "https://xbrl.{authority}/{taxonomy}/{version}/{taxonomy}-{version}.zip"),
    (r"https?://(?:www\.)?([^/]+)/([^/]+)/(\d{4})", "https://xbrl.{authority}/{taxonomy}/{version}/{taxonomy}-{version}.zip"),
    (r"https?://(?:www\.)?([^/]+)/(?:taxonomy/)?([^/]+)/(\d{4})", "https://{authority}/{taxonomy}/{version}.zip"),
    (r"https?://(?:www\.)?([^/]+)/[^/]+/([^/]+)/(\d{4})", "https://{authority}/taxonomies/{taxonomy}-{version}.zip"),
)
ALTERNATIVES = (
    "https://xbrl.{authority}/{taxonomy}-{version}.zip",
    "https://xbrl.{authority}/{taxonomy}/{version}/{taxonomy}-{version}.zip",
    "https://www.xbrl.org/taxonomies/{taxonomy}/{version}.zip",
    "https://{authority}/taxonomy/{taxonomy}-{version}.zip",
    "https://{authority}/taxonomies/{taxonomy}/{version}/{taxonomy}-{version}.zip",
    "https://{authority}/info/edgar/edgartaxonomies/{taxonomy}-{version}.zip",
    "https://www.{authority}/content/dam/{authority}/standards/taxonomy/{version}.zip",
)
AUTHORITY_SPELLINGS = {
    "fasb.org": ("fasb.org", "xbrl.fasb.org"),
    "sec.gov": ("sec.gov", "xbrl.sec.gov", "www.sec.gov"),
    "ifrs.org": ("ifrs.org", "www.ifrs.org", "xbrl.ifrs.org"),
    "esma.europa.eu": ("esma.europa.eu", "www.esma.europa.eu"),
}
MARKETS = (("sec.gov", "sec"), ("fasb.org", "sec"), ("ifrs.org", "ifrs"), ("esma.europa.eu", "esma"), ("fca.org.uk", "fca"))
STANDARD = (
    "http://www.w3.org/2001/XMLSchema", "http://www.w3.org/2001/XMLSchema-instance", "http://www.xbrl.org/2003/instance", "http://www.xbrl.org/2003/linkbase", "http://www.xbrl.org/2003/XLink",
    "http://www.xbrl.org/2006/xbrldi", "http://www.w3.org/1999/xlink", "http://www.w3.org/1999/xhtml", "http://www.w3.org/XML/1998/namespace",
)


def _filled(template: Column, authority: Column, taxonomy: Column, version: Column) -> Column:
    out = template
    for name, value in (("{authority}", authority), ("{taxonomy}", taxonomy), ("{version}", version)):
        out = F.replace(out, F.lit(name), value)
    return out


def market(authority: Column) -> Column:
    """The market of an authority, else the first part of its name."""
    out = F
    for part, name in MARKETS:
        out = out.when(F.lower(authority).contains(part), name)
    return out.otherwise(F.substring_index(authority, ".", 1))


def recognised(uri: Column) -> Column:
    """Struct of taxonomy, version, authority, url and market by the first form that is found in the address; unknown and empty texts without one.

    is_recognised tells which. A null is unknown.
    """
    none = F.struct(F.lit("unknown").alias("taxonomy"), F.lit("unknown").alias("version"), F.lit("").alias("authority"), F.lit("").alias("url"), F.lit("unknown").alias("market"), F.lit(False).alias("is_recognised"))
    group = lambda pattern, k: F.regexp_extract(uri, f"(?i){pattern}", k)
    tries = F.array(*[F.struct(group(p, 1).alias("authority"), F.lower(group(p, 2)).alias("taxonomy"), group(p, 3).alias("version"), F.lit(t).alias("template")) for p, t in PATTERNS])
    first = F.get(F.filter(tries, lambda r: r["version"] != ""), F.lit(0))
    # The one that is found is bound to a variable, so that its parts are not worked out again for each use.
    named = lambda r: F.when(r.isNull(), none).otherwise(F.struct(r["taxonomy"].alias("taxonomy"), r["version"].alias("version"), r["authority"].alias("authority"), _filled(r["template"], r["authority"], r["taxonomy"], r["version"]).alias("url"), market(r["authority"]).alias("market"), F.lit(True).alias("is_recognised")))
    return F.get(F.transform(F.array(first), named), F.lit(0))


def alternative_urls(uri: Column, taxonomy: Column, version: Column) -> Column:
    """Array of addresses to try, each once: templates, then spellings of the authority; the namespace itself is left out. Empty without an authority."""
    authority = F.regexp_extract(uri, r"(?i)https?://(?:www\.|xbrl\.)?([^/]+)", 1)
    low, spellings = F.lower(authority), F
    for name, several in AUTHORITY_SPELLINGS.items():
        spellings = spellings.when(low.contains(name) | F.lit(name).contains(low), F.array(*map(F.lit, several)))
    spellings = spellings.otherwise(F.array(authority))
    filled = lambda template: F.transform(spellings, lambda a: _filled(F.lit(template), a, taxonomy, version))
    every = F.flatten(F.array(*map(filled, ALTERNATIVES)))
    return F.when(authority == "", F.array().cast("array<string>")).otherwise(F.array_remove(F.array_distinct(every), uri))


def is_standard(uri: Column) -> Column:
    """One of the namespaces that name no taxonomy."""
    return F.coalesce(uri.isin(*STANDARD), F.lit(False))
