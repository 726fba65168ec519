"""Filings from stored search responses: JSON texts in a column, one response a row, read by one pass in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Attributes of a filing and of an entity in responses of the European index, and defaults of its pages.
FILING = ("fxo_id", "country", "date_added", "period_end", "report_url", "viewer_url", "json_url", "package_url", "sha256", "processed", "error_count", "warning_count")
ENTITY = ("name", "lei", "country", "identifier")
PAGES = {"total_count": 0, "total_pages": 0, "current_page": 1, "page_size": 25}

# Kinds of distributions by parts of a content type and by ends of an address, in order of trial.
ARCHIVE_TYPES = ("application/zip", "application/x-zip-compressed", "application/x-tar", "application/gzip", "application/x-gzip", "application/x-compressed", "application/x-bzip2", "application/x-xz")
INLINE_TYPES = ("application/xhtml+xml",)
INLINE_ENDS = (".xhtml", ".html", ".htm")
SCHEMA_TYPES = ("text/xml", "application/xml", "application/xsd+xml", "application/xsd")
DIRECTORY_TYPES = ("text/html",)
ARCHIVE_ENDS = (".zip", ".tar.gz", ".tar", ".tgz", ".tar.xz", ".tar.bz2")
SCHEMA_ENDS = (".xsd", ".xml")


def _fields(names: tuple[str, ...]) -> str:
    return ", ".join(f"{n}: string" for n in names)


_ITEM = f"struct<id: string, type: string, attributes: struct<{_fields(FILING)}>, relationships: struct<entity: struct<data: struct<id: string, type: string>>>>"
_INCLUDED = f"struct<id: string, type: string, attributes: struct<{_fields(ENTITY)}>>"
_EUROPEAN = f"struct<data: array<{_ITEM}>, included: array<{_INCLUDED}>, meta: struct<{', '.join(f'{n}: long' for n in PAGES)}>>"


def european_filings(responses: DataFrame, body: str = "body") -> DataFrame:
    """A row for each filing of JSON-API responses, with the entity that the same response includes.

    Of several included entities with one id the last counts. An entity that is not included has its id alone. A text
    that is no response, or one without data, gives no row; items without any value are left out.
    """
    r = F.from_json(body, _EUROPEAN)
    found = responses.select(r["included"].alias("included"), F.explode(r["data"]).alias("item")).filter("item.id is not null or item.type is not null or item.attributes is not null")
    entity_id = F.col("item.relationships.entity.data.id")
    own = F.filter("included", lambda e: (e["type"] == "entity") & (e["id"] == entity_id))
    found = found.withColumn("entity", F.try_element_at(own, F.lit(-1)))
    return found.select(
        F.col("item.id").alias("filing_id"), F.col("item.type").alias("filing_type"), *[F.col(f"item.attributes.{n}").alias(n) for n in FILING],
        entity_id.alias("entity_id"), *[F.col(f"entity.attributes.{n}").alias(f"entity_{n}") for n in ENTITY],
    )


def pages(responses: DataFrame, body: str = "body") -> DataFrame:
    """Where each response stands among the pages of its search; what it doesn't say has a default."""
    meta = F.from_json(body, _EUROPEAN)["meta"]
    return responses.select(*[F.coalesce(meta[n], F.lit(v)).cast("long").alias(n) for n, v in PAGES.items()])


def recent_filings(responses: DataFrame, form: str, most: int, start: str | None = None, end: str | None = None, body: str = "body") -> DataFrame:
    """cik, place, accession, filing_date and form from submission lists (cik, body), which hold a column in each array.

    Rows of the form wanted, with dates (ISO texts) between start and end; the first ``most`` of each list, in its order. Arrays are
    read as far as the shortest of them reaches.
    """
    names = ("accessionNumber", "filingDate", "form")
    recent = F.from_json(body, f"struct<filings: struct<recent: struct<{', '.join(f'{n}: array<string>' for n in names)}>>>")["filings"]["recent"]
    lists = [recent[n] for n in names]
    shortest = F.array_min(F.array(*[F.coalesce(F.size(x), F.lit(0)) for x in lists]))
    zipped = F.slice(F.arrays_zip(*[x.alias(n) for x, n in zip(lists, ("accession", "filing_date", "form"), strict=True)]), F.lit(1), F.greatest(shortest, F.lit(0)))

    def wanted(x: Column) -> Column:
        inside = x["form"] == form
        if start:
            inside &= x["filing_date"] >= start
        if end:
            inside &= x["filing_date"] <= end
        return inside

    return responses.select("cik", F.posexplode(F.slice(F.filter(zipped, wanted), 1, most)).alias("place", "f")).select("cik", "place", "f.*")


def distribution_type(content_type: Column, url: Column) -> Column:
    """archive, ixbrl, xsd, directory or unknown: by the content type, then by the end of the address."""
    kind, address = F.lower(F.coalesce(content_type, F.lit(""))), F.lower(F.coalesce(url, F.lit("")))

    def some(test: str, text: Column, values: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for v in values:
            out = out | getattr(text, test)(v)
        return out

    return (
        F.when(some("contains", kind, ARCHIVE_TYPES), "archive")
        .when(some("contains", kind, INLINE_TYPES) | some("endswith", address, INLINE_ENDS), "ixbrl")
        .when(some("contains", kind, SCHEMA_TYPES), "xsd")
        .when(some("contains", kind, DIRECTORY_TYPES), "directory")
        .when(some("endswith", address, ARCHIVE_ENDS), "archive")
        .when(some("endswith", address, SCHEMA_ENDS), "xsd")
        .when(address.endswith("/"), "directory")
        .otherwise("unknown")
    )


# Attributes of British company profiles and filings with their kinds, the format that counts as inline, the
# market's name, ends of package names in order of trial.
PROFILE = "company_number string, company_name string, company_status string, type string, jurisdiction string, date_of_creation string, sic_codes array<string>"
HISTORY_ITEM = "transaction_id string, type string, description string, category string, date string, action_date string, barcode string, subcategory string, pages long, paper_filed boolean, preferred_format string, links struct<document_metadata: string>"
INLINE_FORMAT, BRITISH, DEFAULT_JURISDICTION = "application/xhtml+xml", "uk", "england-wales"
PACKAGE_ENDS = ("_htm.zip", "_xbrl.zip", "-xbrl.zip", "r2.zip", ".zip")


def british_filings(responses: DataFrame, profile: str = "profile", history: str = "history") -> DataFrame:
    """Standard result rows of British filings from stored responses: a company's profile and its filing history, both JSON texts.

    entity_id, company_name, form_type, filing_date, accession_number, market_id, place (in the history), filing_description,
    filing_category, period_end (the action's date, else the filing's), document_id (of the metadata's address), is_inline,
    jurisdiction, pages, paper_filed. A response without items, or that is no JSON, gives no row; what is missing is null, the
    jurisdiction and paper_filed have defaults.
    """
    items = F.from_json(history, f"struct<items: array<struct<{_colons(HISTORY_ITEM)}>>>")["items"]
    rows = responses.select(F.from_json(profile, PROFILE).alias("p"), F.posexplode(items).alias("place", "i"))
    return rows.select(
        F.col("p.company_number").alias("entity_id"), F.col("p.company_name").alias("company_name"), F.col("i.type").alias("form_type"), F.col("i.date").alias("filing_date"), F.col("i.transaction_id").alias("accession_number"),
        F.lit(BRITISH).alias("market_id"), "place", F.col("i.description").alias("filing_description"), F.col("i.category").alias("filing_category"),
        F.coalesce(F.nullif(F.col("i.action_date"), F.lit("")), F.col("i.date")).alias("period_end"), F.nullif(F.regexp_extract("i.links.document_metadata", "/document/([^/]+)", 1), F.lit("")).alias("document_id"),
        F.coalesce(F.col("i.preferred_format") == INLINE_FORMAT, F.lit(False)).alias("is_inline"), F.coalesce("p.jurisdiction", F.lit(DEFAULT_JURISDICTION)).alias("jurisdiction"), "i.pages", F.coalesce("i.paper_filed", F.lit(False)).alias("paper_filed"),
    )


def _colons(schema: str) -> str:
    return ", ".join(x.replace(" ", ": ", 1) for x in schema.split(", "))


def standard_rows(filings: DataFrame, market: str, **columns: str) -> DataFrame:
    """Rows of any market as filing_url, form_type, filing_date, company_name, entity_id, accession_number, market_id.

    columns: under which name filings has each of them; one that is not given is null. The market is the same for all.
    """
    names = ("filing_url", "form_type", "filing_date", "company_name", "entity_id", "accession_number")
    if unknown := set(columns) - set(names):
        raise ValueError(f"no such columns of results: {sorted(unknown)}")
    return filings.select(*[(F.col(columns[n]).cast("string") if n in columns else F.lit(None).cast("string")).alias(n) for n in names], F.lit(market).alias("market_id"))


def package_of(names: Column) -> Column:
    """Of the file names of a filing's folder (an array) the package: the first name with the first end that any of them has; null without."""
    first = lambda end: F.get(F.filter(names, lambda n: n.endswith(end)), F.lit(0))
    return F.coalesce(*map(first, PACKAGE_ENDS))


def package_in(index: Column) -> Column:
    """The package that a folder's stored index (a JSON text: directory, item, name) lists."""
    items = F.from_json(index, "struct<directory: struct<item: array<struct<name: string>>>>")["directory"]["item"]
    return package_of(F.filter(F.transform(items, lambda i: i["name"]), lambda n: n.isNotNull()))
