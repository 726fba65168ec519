"""Files, XML, namespaces, validation and schemas on small inputs."""

import pytest
from pyspark.sql import functions as F

from auditloom.functions import namespaces as NS
from auditloom.operators import evolution, lookups, namespaces, validation
from auditloom.sources import files, instance_xml, linkbase_xml, searches


def tree(root, *paths):
    for p in paths:
        at = root / p
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(p)
    return f"file://{root}"


MAPPED = (
    "sec/Apple_Inc/filings/10-K/2024-09-28/json/MAIN_FINANCIAL_STATEMENTS.json", "sec/Apple_Inc/filings/10-K/2024-09-28/json/core/balance.json", "sec/Apple_Inc/filings/10-K/2024-09-28/excel/a.xlsx",
    "sec/Apple_Inc/filings/10-K/2024-09-28/notes.csv", "Beta/AFR/2023/statements.json", "Beta/AFR/2023/a.json", "Gamma/10-Q/csv/x.csv", "Gamma/loose.json", "json/MAIN_FINANCIAL_STATEMENTS.json", "top.txt",
)


def test_catalog_of_a_real_tree(spark, tmp_path):
    found = files.discover(spark, tree(tmp_path, *MAPPED))
    rows = {r.folder: r for r in files.mapped_filings(found.drop("folder")).collect()}
    assert set(rows) == {"sec/Apple_Inc/filings/10-K/2024-09-28", "Beta/AFR/2023", "Gamma/10-Q", ""}
    apple, beta, gamma, top = (rows[k] for k in ("sec/Apple_Inc/filings/10-K/2024-09-28", "Beta/AFR/2023", "Gamma/10-Q", ""))
    assert (apple.market, apple.company, apple.form, apple.date, apple.n_json, apple.n_csv, apple.n_excel) == ("sec", "Apple_Inc", "10-K", "2024-09-28", 2, 1, 1)
    assert apple.main_file == MAPPED[0] and beta.main_file.endswith("statements.json") and gamma.main_file is None and top.main_file == "json/MAIN_FINANCIAL_STATEMENTS.json"
    assert (beta.market, beta.company, beta.form, beta.date) == ("unknown", "Beta", "AFR", "2023") and (gamma.company, gamma.form, gamma.date) == ("Gamma", "10-Q", "unknown")
    assert files.mapped_filings(found.drop("folder").limit(0)).count() == 0


def test_other_catalogs_and_checksums(spark, tmp_path):
    root = tree(tmp_path, "us-gaap-2024/elts/a.xsd", "us-gaap-2024/b.xml", "ifrs/c.XSD", "loose.xsd", "sec/A/10-K/2024/parsed.json", "uk/B/parsed.json")
    found = files.discover(spark, root, content=True)
    assert {(r.directory, r.n_files, r.n_schemas) for r in files.taxonomy_locations(found, "libraries").collect()} == {("us-gaap-2024", 2, 1), ("ifrs", 1, 1), ("sec", 1, 0), ("uk", 1, 0)}
    assert {(r.folder, r.market, r.company) for r in files.parsed_filings(found).collect()} == {("sec/A/10-K/2024", "sec", "A"), ("uk/B", "uk", "uk")}
    (digest,) = files.with_checksum(found.filter("name = 'b.xml'")).select("sha256").first()
    import hashlib

    assert digest == hashlib.sha256(b"us-gaap-2024/b.xml").hexdigest()


def test_places_of_folders(spark):
    cases = {"sec/A/filings/10-K/2024": ("sec", "A", "10-K", "2024"), "A/10-K/2024-01": ("unknown", "A", "10-K", "2024-01"), "sec/A/annual": ("sec", "A", "annual", "unknown"), "A/10-K": ("unknown", "A", "10-K", "unknown"), "A": ("unknown", "A", "unknown", "unknown"), "x/UK/A/f/2020": ("UK", "A", "f", "2020"), "": ("unknown",) * 4, "esef/2020": ("esef", "esef", "2020", "unknown")}
    df = spark.createDataFrame([(k,) for k in cases], "folder string").select("folder", files.place_of(F.col("folder")).alias("p")).select("folder", "p.*")
    assert {r.folder: tuple(r)[1:] for r in df.collect()} == cases


def test_a_filing_is_found_by_any_spelling(spark):
    rows = [("f1", "sec", "Apple Inc", "10-K", "2023-09-30"), ("f2", "sec", "Apple Inc", "10_K", "2024-09-28"), ("f3", "sec", "Apple Inc Holdings", "10-K", "2025-01-01"), ("f4", "unknown", "Beta", "annual_report", "2024"), ("f5", "esef", "Apple Inc", "10-K", "2026")]
    catalog = spark.createDataFrame(rows, "folder string, market string, company string, form string, date string")
    wanted = [(1, "SEC", "apple-inc", "form10k", None), (2, "sec", "APPLE INC", "10-K", "2023"), (3, "sec", "Apple", "10-K", "2025-01-01"), (4, "uk", "Beta", "annual", "2024-12-31"), (5, "sec", "Apple Inc", "10-Q", None), (6, "sec", "Other", "10-K", None)]
    out = files.find_filing(catalog, spark.createDataFrame(wanted, "want_id int, market string, company string, form string, date string")).collect()
    assert {r.want_id: r.folder for r in out} == {1: "f2", 2: "f1", 3: "f3", 4: "f4"}


def test_instance_documents(spark):
    names = ["a_cal.xml", "a.xsd", "big.xml", "r2.htm", "FilingSummary.xml", "a_htm.xml", "small.htm"]
    df = spark.createDataFrame([("f", n, f"f/{n}", 100 * (k + 1), "x") for k, n in enumerate(names)] + [("g", "p.htm", "g/p.htm", 5, "x"), ("g", "q.htm", "g/q.htm", 50, "x"), ("h", "x.xsd", "h/x", 1, "x")], "folder string, name string, path string, length long, file_type string")
    assert {r.folder: r.name for r in files.instance_documents(df).collect()} == {"f": "a_htm.xml", "g": "q.htm"}


SCHEMA = """<xs:schema xmlns:xs="x" xmlns:l="l" xmlns:xl="xl"><xs:import namespace="n" schemaLocation="../b/b.xsd"/><xs:import namespace="w" schemaLocation="http://w.org/w.xsd#a"/><xs:include schemaLocation="./c.xsd"/>
<xs:annotation><xs:appinfo><l:linkbaseRef xl:href="a_cal.xml"/><l:roleType roleURI="http://r" id="R"><l:definition> 1 - Balance </l:definition><l:usedOn>l:calculationLink</l:usedOn></l:roleType></xs:appinfo></xs:annotation>
<xs:complexType name="T"><xs:complexContent><xs:extension base="B"/></xs:complexContent></xs:complexType><xs:simpleType name="S"><xs:restriction base="xs:string"/></xs:simpleType><xs:complexType/>
<xs:element name="Cash" id="g_Cash" type="m" periodType="instant" balance="debit" abstract="false"/></xs:schema>"""


def test_schemas_their_types_roles_and_what_they_build_on(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "a.xsd").write_text(SCHEMA)
    (tmp_path / "a" / "a_cal.xml").write_text(SCHEMA.replace("1 - Balance", "late"))
    path = f"file://{tmp_path}/a/a.xsd"
    found = linkbase_xml.imports(spark, path)
    assert {(r.kind, r.namespace, r.location) for r in found.collect()} == {("import", "n", "../b/b.xsd"), ("import", "w", "http://w.org/w.xsd#a"), ("include", None, "./c.xsd"), ("linkbaseRef", None, "a_cal.xml")}
    edges = linkbase_xml.dependencies(found)
    assert {r.target.split(tmp_path.name)[-1] for r in edges.collect()} == {"/b/b.xsd", "http://w.org/w.xsd", "/a/c.xsd", "/a/a_cal.xml"}
    start = edges.select(F.col("source").alias("file")).distinct()
    assert lookups.closure.__name__ == "closure" and start.count() == 1
    assert {(r.kind, r.name, r.base) for r in linkbase_xml.types_of(spark, path).collect()} == {("complex", "T", "B"), ("simple", "S", "xs:string")}
    (role,) = linkbase_xml.first_roles(linkbase_xml.role_types(spark, f"file://{tmp_path}/a")).collect()
    assert (role.role, role.role_id, role.definition) == ("http://r", "R", "1 - Balance")
    (e,) = linkbase_xml.elements(spark, path).collect()
    assert (e.name, e.period_type, e.balance, e.abstract) == ("Cash", "instant", "debit", False)


def test_well_formed_texts(spark):
    cases = {"<a><b/></a>": True, '<?xml version="1.0"?>\n<!-- c --><a x="1"/> \n': True, "<!DOCTYPE html [<!ENTITY e 'x'>]><a/>": True, "<a/><b/>": False, "<a/>tail": False, "text": False, "": False, "<a><b></a>": False, "<a": False, "<a x=1/>": False}
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "xml string")
    assert {r.xml: r.well_formed for r in linkbase_xml.well_formed(df).collect()} == cases | {None: False}


def test_contexts_of_instances(spark):
    member = '<d:explicitMember dimension="p:A"> p:x </d:explicitMember><d:explicitMember dimension="p:A">p:y</d:explicitMember>'
    context = lambda id_, seg, period, sc="": f'<i:context id="{id_}"><i:entity><i:identifier scheme="s"> 7 </i:identifier>{seg}</i:entity><i:period>{period}</i:period>{sc}</i:context>'
    doc = "<i:xbrl xmlns:i='i' xmlns:d='d' xmlns:p='p'>" + context("c1", f"<i:segment>{member}</i:segment>", "<i:instant>2024-02-30</i:instant>", "<i:scenario><d:explicitMember dimension='p:A'>p:z</d:explicitMember><d:typedMember dimension='p:T'><p:v>1</p:v></d:typedMember></i:scenario>") + context("c2", "", "<i:forever/>") + context("", "", "<i:instant>2024-01-01</i:instant>") + "</i:xbrl>"
    p = instance_xml.parsed(spark.createDataFrame([(1, doc), (2, "<i:xbrl"), (3, None), (4, "<x/>")], "filing_id int, xml string"))
    rows = instance_xml.contexts(p).collect()
    assert [(r.context_id, r.entity, r.kind, r.instant, dict(r.dims), r.typed) for r in rows] == [("c1", "7", "instant", None, {"p:A": "p:y", "p:T": "1"}, ["p:T"]), ("c2", "7", "forever", None, {}, [])]
    assert {r.filing_id for r in instance_xml.broken(p).collect()} == {2, 3}
    defaults = F.create_map(F.lit("p:A"), F.lit("p:y"), F.lit("p:T"), F.lit("1"))
    assert [r[0] for r in instance_xml.contexts(p).select(instance_xml.is_default(F.col("dims"), defaults)).collect()] == [True, True]
    assert [r[0] for r in instance_xml.contexts(p).select(instance_xml.is_default(F.col("dims"), F.create_map(F.lit("p:A"), F.lit("p:y")))).collect()] == [False, True]


# --- namespaces ------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("uri", "want"),
    [
        ("http://fasb.org/us-gaap/2024", ("us-gaap", "2024", "fasb.org", "https://xbrl.fasb.org/us-gaap/2024/us-gaap-2024.zip", "sec")),
        ("http://xbrl.sec.gov/dei/2023", ("dei", "2023", "sec.gov", "https://xbrl.sec.gov/dei/2023/dei-2023.zip", "sec")),
        ("http://custom.org/a/My/2025", ("my", "2025", None, None, None)),
        ("http://example.com/none", ("unknown", "unknown", "", "", "unknown")),
        (None, ("unknown", "unknown", "", "", "unknown")),
    ],
)
def test_forms_of_namespaces(spark, uri, want):
    got = tuple(spark.createDataFrame([(uri,)], "u string").select(NS.recognised(F.col("u")).alias("r")).first().r)[:5]
    assert all(w is None or g == w for g, w in zip(got, want, strict=True)), got


def test_standard_and_unknown_namespaces(spark):
    df = spark.createDataFrame([("http://www.w3.org/1999/xlink",), ("http://a.com/x",), ("http://a.com/x",), ("http://a.com/t/2020",), (None,)], "uri string")
    assert [tuple(r) for r in namespaces.unrecognised(df).collect()] == [("http://a.com/x", 2)]
    assert namespaces.taxonomies(df).filter("is_recognised").count() == 1


def test_the_longest_beginning_owns(spark):
    owners = spark.createDataFrame([("http://a.com", "A"), ("a.com/x", "X"), ("a.com/x/", "W"), ("a.com/x/y", "Y"), ("", "nobody")], "prefix string, owner string")
    uris = {"https://a.com/x/y/z?q": "Y", "a.com/x": "W", "a.com/xy": "A", "http://a.com": "A", "b.com/x": None, "": None, None: None}
    df = spark.createDataFrame([(u,) for u in uris], "uri string")
    assert {r.uri: r.owner for r in namespaces.longest_prefix(df, owners).filter("uri is not null").collect()} == {k: v for k, v in uris.items() if k is not None}


def test_namespaces_declared_anywhere(spark):
    texts = {1: '{"a": "http://x", "b": "t"}', 2: '{"a": "http://x", "b": "t", "c": 5}', 3: '[{"k": {"p": "https://y", "q": "http://z", "r": "odd"}}]', 4: "no json", 5: None, 6: "{}", 7: '{"m": "http://o", "deep": {"n": "http://i"}, "e": "https://e"}'}
    df = spark.createDataFrame(list(texts.items()), "filing_id int, j string")
    got = {(r.filing_id, r.uri) for r in namespaces.declared(df, "j").collect()}
    assert got == {(3, "https://y"), (3, "http://z"), (3, "odd"), (7, "http://o"), (7, "https://e"), (7, "http://i")}
    assert namespaces.declared(df.limit(0), "j").count() == 0


# --- validation and schemas ------------------------------------------------------------------------------


def test_stages_stop_at_the_first_with_errors(spark):
    rules = [validation.Rule("one", "positive", F.col("v") > 0, "not positive"), validation.Rule("two", "small", F.col("v") < 10, F.concat(F.lit("is "), F.col("v"))), validation.Rule("one", "even", F.col("v") % 2 == 0)]
    df = spark.createDataFrame([(1, 4), (2, -3), (3, 20), (4, None)], "i int, v int")
    out = {r.i: r for r in validation.validate(df, rules).collect()}
    assert [out[i].is_valid for i in (1, 2, 3, 4)] == [True, False, False, False]
    assert out[1].stages == ["one", "two"] and out[2].stages == ["one"] and out[3].errors == [("two", "small", "is 20")]
    assert [e.rule for e in out[2].errors] == ["positive", "even"] and "could not be applied" in out[4].errors[0].message
    everything = {r.i: len(r.errors) for r in validation.validate(df, rules, fail_fast=False).collect()}
    assert everything == {1: 0, 2: 2, 3: 1, 4: 3}
    (total,) = validation.in_batches(validation.validate(df, rules)).collect()
    assert tuple(total) == (4, 1, 5, 25.0)
    assert validation.validate(df, []).filter("is_valid").count() == 4


def test_checks_of_extracted_packages(spark):
    df = spark.createDataFrame([("a.xsd", 5, 1, "ok"), ("b.exe", 5, 1, "ok"), ("c.xml", 0, 1, ""), ("d.xml", None, 0, None), ("e.xml", 5, 1, "bad �")], "name string, length long, n int, text string")
    rules = validation.extraction_rules(F.col("length"), F.col("text"), F.col("n"), (".xsd", ".xml"), F.col("name"))
    got = {r.name: [e.rule for e in r.errors] for r in validation.validate(df, rules).collect()}
    assert got == {"a.xsd": [], "b.exe": ["known_kind"], "c.xml": ["not_empty"], "d.xml": ["length_known", "some_files"], "e.xml": ["readable"]}


def test_schemas_differ_and_rows_follow(spark):
    have = spark.createDataFrame([(1, "a", 2.0, (3, [4]))], "ID int, name string, x double, s struct<p: int, q: array<int>>")
    want = spark.createDataFrame([], "id bigint, x float, extra date, s struct<p: int, q: array<bigint>>, name binary")
    assert {(r.column, r.change) for r in evolution.schema_diff(have, want).collect()} == {("id", "widen"), ("x", "narrow"), ("extra", "add"), ("s.q[]", "widen"), ("name", "replace")}
    with pytest.raises(ValueError, match="column x"):
        evolution.evolved(have, want)
    out = evolution.evolved(have, want.select("id", "extra"))
    assert out.dtypes == [("id", "bigint"), ("extra", "date")] and out.collect() == [(1, None)]
    assert evolution.schema_diff(have, have).count() == 0


def test_british_results_and_packages(spark):
    profile = '{"company_number": "01", "company_name": "A"}'
    history = '{"items": [{"transaction_id": "t", "type": "AA", "date": "2024-01-02", "links": {"document_metadata": "https://h/document/D1/metadata"}, "preferred_format": "application/xhtml+xml"}]}'
    df = spark.createDataFrame([(profile, history), (profile, "{}"), (None, None), ("x", history)], "profile string, history string")
    rows = searches.british_filings(df).collect()
    assert [(r.entity_id, r.accession_number, r.period_end, r.document_id, r.is_inline, r.jurisdiction) for r in rows] == [("01", "t", "2024-01-02", "D1", True, "england-wales"), (None, "t", "2024-01-02", "D1", True, "england-wales")]
    with pytest.raises(ValueError):
        searches.standard_rows(df, "uk", nothing="x")
    index = '{"directory": {"item": [{"name": "a.zip"}, {"name": "a-xbrl.zip"}, {"name": null}, {"name": "b_xbrl.zip"}]}}'
    assert spark.createDataFrame([(index,), ("{}",), (None,)], "i string").select(searches.package_in(F.col("i"))).collect() == [("b_xbrl.zip",), (None,), (None,)]


# --- filings in JSON ---------------------------------------------------------------------------------------

PARSED = """{"metadata": {"document_type": "10-K"}, "instance": {"facts": [{"concept": "us-gaap:Cash", "value": "5", "context_ref": "c1", "unit_ref": "u1", "decimals": "0"}, {"name": "us-gaap:Debt", "fact_value": "7", "contextRef": "c9", "unit": "u9"}],
"contexts": {"c1": {"id": "c1", "entity": {"identifier": "77"}, "period": {"type": "duration", "start_date": "2024-01-01", "end_date": "2024-12-31"}, "segment": {"a:Axis": "a:x"}, "scenario": {"a:Axis": "a:y", "b:Axis": "b:z"}}},
"units": [{"id": "u1", "measures": ["USD"]}, {"id": "u2", "numerator": ["USD"], "denominator": ["shares"]}]}}"""
MAPPED_FILE = """{"role_uri": "r", "statement_type": "BALANCE_SHEET", "facts": [{"concept": "Cash", "value": "5", "contextRef": "c1", "isTotal": true, "level": 2, "endDate": "2024-12-31"}, {"name": "Head", "is_abstract": true}]}"""


def test_filings_in_json(spark, tmp_path):
    from auditloom.sources import filing_json as J

    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "parsed.json").write_text(PARSED)
    filings = J.read_filings(spark, f"file://{tmp_path}/p")
    f, c, u = J.facts(filings), J.contexts(filings), J.units(filings)
    assert [(r.concept, r.value, r.context_id, r.unit) for r in f.orderBy("fact_seq").collect()] == [("us-gaap:Cash", "5", "c1", "u1"), ("us-gaap:Debt", "7", "c9", "u9")]
    (ctx,) = c.collect()
    assert (ctx.context_id, ctx.entity, str(ctx.end), dict(ctx.dims)) == ("c1", "77", "2024-12-31", {"a:Axis": "a:x", "b:Axis": "b:z"})
    assert {(r.unit_id, r.measure) for r in u.collect()} == {("u1", "USD"), ("u2", "USD/shares")}
    assert {(r.concept, r.measure, r.dimension_count) for r in J.with_context(f, c, u).collect()} == {("us-gaap:Cash", "USD", 2), ("us-gaap:Debt", None, None)}
    assert {(r.concept, r.problem) for r in J.broken_references(f, c, u).collect()} == {("us-gaap:Debt", "context"), ("us-gaap:Debt", "unit")}


def test_mapped_statements_in_json(spark, tmp_path):
    from auditloom.sources import filing_json as J

    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "s.json").write_text(MAPPED_FILE)
    rows = {r.concept: r for r in J.statements(spark, f"file://{tmp_path}/m").collect()}
    assert (rows["Cash"].context_id, rows["Cash"].is_total, rows["Cash"].depth, rows["Cash"].period_end, rows["Cash"].bytes) == ("c1", True, 2, "2024-12-31", len(MAPPED_FILE))
    assert rows["Head"].is_abstract and rows["Head"].value is None


def test_files_beyond_the_limits_are_listed(spark, tmp_path, monkeypatch):
    root = tree(tmp_path, "a/b/c.txt", "d.txt", "long_name_of_a_file.txt")
    monkeypatch.setattr(files, "MAX_BYTES", 10)
    monkeypatch.setattr(files, "MAX_DEPTH", 2)
    assert {r.below for r in files.discover(spark, root).collect()} == {"d.txt"}
    assert {(r.path.rsplit("/", 1)[-1], r.why) for r in files.left_out(spark, root).collect()} == {("c.txt", "too deep"), ("long_name_of_a_file.txt", "too large")}


def test_european_names(spark):
    from auditloom.functions import checks, names

    df = spark.createDataFrame([("10-K", "Balance Sheet"), (" half year ", "profit_or-loss_details"), ("S-1", "Segments"), ("qfr", "Notes")], "f string, n string")
    assert [tuple(r) for r in df.select(names.european_form(F.col("f")), checks.european_slot(F.col("n"))).collect()] == [("AFR", None), ("SFR", "income_statement"), ("S-1", None), ("QFR", "notes")]
