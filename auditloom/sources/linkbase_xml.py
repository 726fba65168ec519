"""Linkbases and schemas in XML: arcs, role types, elements, imports, signs in inline documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditloom.functions.names import href_concept

_LOC = "array<struct<_label: string, _href: string>>"
_ARC = "array<struct<_from: string, _to: string, _order: string, _weight: string, _priority: string, _use: string, _preferredLabel: string, _arcrole: string>>"


def _projected(raw: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of links (keys, kind, role, loc, arc) → a row for each arc, locators resolved to concepts.

    Locators and both ends of arcs become rows that meet on the link and the label, so that a link of any length is
    resolved in proportion to its arcs and is never held whole.
    """
    none = lambda t: F.lit(None).cast(t)
    arc_type = _ARC.removeprefix("array<").removesuffix(">")
    entry = lambda label, end, seq, href, a: F.struct(label.alias("label"), F.lit(end).alias("end"), seq.alias("seq"), href.alias("href"), a.alias("a"))
    listed = lambda c, f: F.coalesce(F.transform(c, f), F.array().cast("array<struct<label: string, end: string, seq: int, href: string, a: " + arc_type + ">>"))
    entries = F.concat(
        listed("loc", lambda x, i: entry(x["_label"], "loc", i, x["_href"], none(arc_type))),
        listed("arc", lambda x, i: entry(x["_from"], "from", i, none("string"), x)),
        listed("arc", lambda x, i: entry(x["_to"], "to", i, none("string"), none(arc_type))),
    )
    # The outer form keeps the parse of the text from being repeated in a filter below it.
    link = raw.withColumn("_link", F.monotonically_increasing_id()).select(*keys, "kind", "role", "_link", F.inline_outer(entries))
    href = F.max_by("href", F.when(F.col("end") == "loc", F.col("seq"))).over(Window.partitionBy("_link", "label"))
    ends = link.withColumn("concept", F.coalesce(href_concept(F.when(F.col("label").isNotNull(), href)), F.col("label"))).filter("end <> 'loc'")
    at = lambda end: F.max(F.when(F.col("end") == end, F.col("concept")))
    each = ends.groupBy(*keys, "kind", "role", "_link", F.col("seq").alias("arc_seq")).agg(at("from").alias("parent"), at("to").alias("child"), F.first(F.when(F.col("end") == "from", F.col("a")), ignorenulls=True).alias("a"))
    return each.select(
        *keys, "role", "arc_seq", "parent", "child", F.coalesce(F.col("a._order").try_cast("double"), F.lit(0.0)).alias("order"),
        F.coalesce(F.col("a._weight").try_cast("double"), F.lit(1.0)).alias("weight"), F.col("a._priority").try_cast("int").alias("priority"), F.col("a._use").alias("use"),
        F.col("a._preferredLabel").alias("preferred_label"), F.col("a._arcrole").alias("arcrole"), "kind",
    )


def arcs(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Arcs of a kind (calculation, presentation, definition) with locators resolved to concepts.

    filing_id is the folder of the file. A locator's last definition counts; an arc whose locator is unknown keeps the
    label. A missing order is 0, a missing weight 1.
    """
    schema = f"_role string, loc {_LOC}, {kind}Arc {_ARC}"
    raw = spark.read.format("xml").option("rowTag", f"{kind}Link").option("ignoreNamespace", "true").option("recursiveFileLookup", "true").schema(schema).load(path)
    # The file's place is taken from the scan's metadata, once, before anything is exploded.
    raw = raw.withColumn("filing_id", F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")).withColumn("file", F.col("_metadata.file_path"))
    return _projected(raw.withColumnsRenamed({"_role": "role", f"{kind}Arc": "arc"}).withColumn("kind", F.lit(kind)), ["filing_id", "file"]).drop("kind")


#: Kinds of networks that a linkbase may hold.
KINDS = ("presentation", "calculation", "definition")


def arcs_of(documents: DataFrame, column: str = "xml", key: str = "filing_id") -> DataFrame:
    """All arcs of linkbases given as text: key, kind and the columns of arcs, by one parse of each text.

    link_seq is the place of a link among those of its kind. A text that is no linkbase or cannot be parsed has no arcs.
    """
    links = ", ".join(f"{k}Link array<struct<_role: string, loc: {_LOC}, {k}Arc: {_ARC}>>" for k in KINDS)
    parsed = documents.select(F.col(key).alias(key), F.from_xml(F.col(column), links, {"ignoreNamespace": "true", "mode": "PERMISSIVE"}).alias("x"))
    of_kind = lambda k: F.transform(F.col(f"x.{k}Link"), lambda x, i: F.struct(i.alias("link_seq"), x["_role"].alias("role"), x["loc"].alias("loc"), x[f"{k}Arc"].alias("arc"), F.lit(k).alias("kind")))
    link = f"array<struct<link_seq: int, role: string, loc: {_LOC}, arc: {_ARC}, kind: string>>"
    return _projected(parsed.select(key, F.inline_outer(F.concat(*[F.coalesce(of_kind(k), F.array().cast(link)) for k in KINDS]))), [key, "link_seq"])


def role_types(spark: SparkSession, path: str) -> DataFrame:
    """filing_id, file, role, role_id, definition of all role types of schemas and linkbases; first_roles picks one for each role."""
    schema = "_roleURI string, _id string, definition string, usedOn array<string>"
    raw = spark.read.format("xml").option("rowTag", "roleType").option("ignoreNamespace", "true").option("recursiveFileLookup", "true").schema(schema).load(path)
    return raw.select(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("filing_id"), F.col("_metadata.file_path").alias("file"), F.col("_roleURI").alias("role"), F.col("_id").alias("role_id"), F.trim("definition").alias("definition"), F.array_join("usedOn", ",").alias("used_on"))


def first_roles(roles: DataFrame) -> DataFrame:
    """Of the definitions of each filing's roles the first: by file, schemas before linkbases, then by id."""
    place = F.struct((~F.col("file").endswith(".xsd")).alias("linkbase"), "file", "role_id")
    return roles.groupBy("filing_id", "role").agg(F.min_by(F.struct("role_id", "definition", "used_on"), place).alias("r")).select("filing_id", "role", "r.*")


def elements(spark: SparkSession, path: str) -> DataFrame:
    """Element declarations of schemas: name, type, period type, balance, abstract, nillable."""
    schema = "_name string, _id string, _type string, _substitutionGroup string, _periodType string, _balance string, _abstract boolean, _nillable boolean"
    raw = spark.read.format("xml").option("rowTag", "element").option("ignoreNamespace", "true").option("recursiveFileLookup", "true").schema(schema).load(path)
    return raw.filter("_name is not null").select(
        F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("filing_id"), F.col("_name").alias("name"), F.col("_id").alias("element_id"), F.col("_type").alias("type"),
        F.col("_substitutionGroup").alias("substitution_group"), F.col("_periodType").alias("period_type"), F.col("_balance").alias("balance"), F.coalesce("_abstract", F.lit(False)).alias("abstract"), F.coalesce("_nillable", F.lit(False)).alias("nillable"),
    )


def _tags(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", "true").option("recursiveFileLookup", "true").schema(schema).load(path)


def imports(spark: SparkSession, path: str) -> DataFrame:
    """file, kind, namespace and location of what the schemas build on: imports, includes and references to linkbases."""
    file = F.col("_metadata.file_path").alias("file")
    schema = "_namespace string, _schemaLocation string"
    rows = [_tags(spark, path, k, schema).select(file, F.lit(k).alias("kind"), F.col("_namespace").alias("namespace"), F.col("_schemaLocation").alias("location")) for k in ("import", "include")]
    rows.append(_tags(spark, path, "linkbaseRef", "_href string").select(file, F.lit("linkbaseRef").alias("kind"), F.lit(None).cast("string").alias("namespace"), F.col("_href").alias("location")))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def dependencies(imported: DataFrame) -> DataFrame:
    """source, target: files and what they build on, relative locations resolved against the file's folder, as closure takes them.

    Web addresses stay as they are; a fragment counts for nothing; a location that is missing or empty gives no row.
    """
    at = F.regexp_replace("location", "#.*$", "")
    joined = F.when(at.rlike("^[A-Za-z][A-Za-z0-9+.-]*:|^/"), at).otherwise(F.concat(F.regexp_replace("file", "[^/]*$", ""), at))
    plain = F.regexp_replace(joined, r"/\./", "/")
    for _ in range(8):  # a/b/../c is a/c; paths that go up further stay as they are
        plain = F.regexp_replace(plain, r"/(?!\.\./)[^/]+/\.\./", "/")
    return imported.filter(F.coalesce(at, F.lit("")) != "").select(F.col("file").alias("source"), plain.alias("target")).distinct()


def types_of(spark: SparkSession, path: str) -> DataFrame:
    """file, kind (complex or simple), name and base of the type definitions of schemas that have a name."""
    file = F.col("_metadata.file_path").alias("file")
    inner = "struct<_base: string>"
    bases = {"complexType": f"_name string, complexContent struct<extension: {inner}, restriction: {inner}>, simpleContent struct<extension: {inner}, restriction: {inner}>", "simpleType": f"_name string, restriction {inner}"}
    complex_ = _tags(spark, path, "complexType", bases["complexType"]).select(file, F.lit("complex").alias("kind"), F.col("_name").alias("name"), F.coalesce("complexContent.extension._base", "complexContent.restriction._base", "simpleContent.extension._base", "simpleContent.restriction._base").alias("base"))
    simple = _tags(spark, path, "simpleType", bases["simpleType"]).select(file, F.lit("simple").alias("kind"), F.col("_name").alias("name"), F.col("restriction._base").alias("base"))
    return complex_.unionByName(simple).filter("name is not null")


def inline_signs(documents: DataFrame) -> DataFrame:
    """filing_id, html → concept, context and sign of each inline number that has a sign, in order of appearance."""
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<ix:nonFraction\b[^>]*>"), 0)
    attr = lambda name: F.regexp_extract("tag", rf'(?is)\b{name}\s*=\s*"([^"]*)"', 1)
    each = documents.select("filing_id", F.posexplode(tags).alias("sign_seq", "tag"))
    return each.select("filing_id", "sign_seq", attr("name").alias("concept"), attr("contextRef").alias("context_id"), attr("sign").alias("sign")).filter("sign != ''")


#: What may stand before the root element: a declaration, comments, instructions, a document type.
_PROLOG = r"(?s)^\s*(<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>\[]*(\[.*?\])?\s*>|\s+)*"


def well_formed(documents: DataFrame, column: str = "xml") -> DataFrame:
    """Adds whether the text parses as XML with exactly one root element and no text beside it; a null does not.

    The text after the prolog is parsed as the content of another element, so that a second root shows.
    """
    inside = F.concat(F.lit("<o><w>"), F.regexp_replace(F.col(column), _PROLOG, ""), F.lit("</w></o>"))
    # The column of what is corrupt has to be the last one: before others, it leaves these empty.
    parsed = F.from_xml(inside, "w struct<xs_any: array<string>, _VALUE: string>, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    one = (F.size(parsed["w"]["xs_any"]) == 1) & parsed["w"]["_VALUE"].isNull()
    return documents.withColumn("well_formed", F.coalesce(parsed["_corrupt_record"].isNull() & one, F.lit(False)))
