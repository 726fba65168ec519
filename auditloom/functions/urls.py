"""Namespaces and URLs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditloom.functions.names import last_segment

# Standard authorities, where their files are downloaded, other hosts to try, and URL patterns in order.
STANDARD_AUTHORITIES = (
    "xbrl.sec.gov", "sec.gov", "fasb.org", "xbrl.fasb.org", "xbrl.org", "www.xbrl.org", "ifrs.org", "xbrl.ifrs.org", "esma.europa.eu", "www.esma.europa.eu", "frc.org.uk",
)
DOWNLOAD_AUTHORITY = {"fasb.org": "xbrl.fasb.org", "sec.gov": "xbrl.sec.gov", "ifrs.org": "xbrl.ifrs.org", "xbrl.org": "xbrl.org", "esma.europa.eu": "www.esma.europa.eu"}
OTHER_AUTHORITIES = {
    "fasb.org": ("xbrl.fasb.org", "fasb.org"), "sec.gov": ("xbrl.sec.gov", "sec.gov"), "xbrl.org": ("xbrl.org", "www.xbrl.org"),
    "ifrs.org": ("xbrl.ifrs.org", "ifrs.org"), "esma.europa.eu": ("www.esma.europa.eu", "esma.europa.eu"),
}
URL_PATTERNS = (
    "{authority}/{taxonomy}/{version}/{taxonomy}-{version}.zip",
    "{authority}/{taxonomy}/{taxonomy}-{version}.zip",
    "{authority}/taxonomies/{taxonomy}-{version}.zip",
    "{authority}/{taxonomy}-{version}.zip",
)
PROTOCOLS = ("https", "http")
MAX_CANDIDATES = 50
RESERVED_NAMES = ("unknown", "company-extension", "custom", "private")
INCLUDED_TAXONOMIES = ("country", "currency", "exch", "naics", "sic", "stpr")
VERSIONS = (2000, 2099)


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"\?([^#]*)", 1)


def scheme(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][\w+.-]*)://", 1)


def file_extension(url: Column) -> Column:
    return F.lower(F.regexp_extract(last_segment(path(url)), r"\.([A-Za-z0-9]+)$", 1))


def file_type(name: Column) -> Column:
    """What a file of a filing is, by the end of its name."""
    t = F.lower(name)
    ends = lambda *x: t.rlike("(" + "|".join(x) + ")$")
    return (
        F.when(ends(r"_cal\.xml"), "calculation").when(ends(r"_pre\.xml"), "presentation").when(ends(r"_def\.xml"), "definition").when(ends(r"_lab\.xml"), "label").when(ends(r"_ref\.xml"), "reference")
        .when(ends(r"\.xsd"), "schema").when(ends(r"\.xml", r"\.xbrl"), "instance").when(ends(r"\.html?", r"\.xhtml"), "inline").when(ends(r"\.json"), "json").when(ends(r"\.zip", r"\.tar", r"\.tgz", r"\.tar\.gz"), "archive")
        .otherwise("other")
    )


def is_company_extension(uri: Column) -> Column:
    """A namespace on a company's own host: .com, .net, .co.uk or .org, unless the host is a standard authority."""
    own = uri.rlike(r"(?i)^https?://(www\.)?[^/]+\.(com|net|co\.uk)/") | (uri.rlike(r"(?i)^https?://(www\.)?[^/]+\.org/") & ~uri.rlike(r"(?i)^https?://(www\.)?[^/]+\.org/xbrl"))
    return own & ~F.lower(host(uri)).isin(*STANDARD_AUTHORITIES)


def is_version(v: Column) -> Column:
    return F.coalesce(v.rlike(r"^\d{4}$") & v.cast("string").between(str(VERSIONS[0]), str(VERSIONS[1])), F.lit(False))


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def namespace_library(uri: Column) -> Column:
    """Struct of taxonomy, version, source and url of a namespace.

    A company's extension is skipped; host/taxonomy/version gives a direct URL, or source "included" for taxonomies
    that come inside others; whatever else is unknown.
    """
    parts = F.filter(F.split(path(uri), "/"), lambda p: p != "")
    taxonomy, version = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    direct = is_version(version) & ~F.lower(taxonomy).isin(*RESERVED_NAMES)
    source = F.when(is_company_extension(uri), "skipped").when(direct & taxonomy.isin(*INCLUDED_TAXONOMIES), "included").when(direct, "direct").otherwise("unknown")
    authority = F.coalesce(F.try_element_at(_map(DOWNLOAD_AUTHORITY), host(uri)), host(uri))
    url = F.concat(F.lit("https://"), authority, F.lit("/"), taxonomy, F.lit("/"), version, F.lit("/"), taxonomy, F.lit("-"), version, F.lit(".zip"))
    return F.struct(
        F.when(source == "skipped", "company-extension").when(source == "unknown", "unknown").otherwise(taxonomy).alias("taxonomy"),
        F.when(source.isin("direct", "included"), version).otherwise("unknown").alias("version"),
        source.alias("source"),
        F.when(source == "direct", url).otherwise("").alias("url"),
    )


def url_candidates(authority: Column, taxonomy: Column, version: Column) -> Column:
    """Array of download URLs to try, in order: protocols, then hosts, then patterns; MAX_CANDIDATES at most."""
    hosts = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in OTHER_AUTHORITIES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), authority), F.array(authority))
    fill = lambda p, h: F.replace(F.replace(F.replace(F.lit(p), F.lit("{authority}"), h), F.lit("{taxonomy}"), taxonomy), F.lit("{version}"), version)
    every = F.flatten(F.flatten(F.transform(F.array(*map(F.lit, PROTOCOLS)), lambda s: F.transform(hosts, lambda h: F.array(*[F.concat(s, F.lit("://"), fill(p, h)) for p in URL_PATTERNS])))))
    return F.slice(F.array_distinct(every), 1, MAX_CANDIDATES)
