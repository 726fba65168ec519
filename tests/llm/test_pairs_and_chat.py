"""Spelling variants, hard negatives, chat formatting and license names against brute force, round trips and odd rows."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditloom.llm import chat, hard_negatives, license_scan, license_texts, sharding, spelling
from auditloom.llm import queries as Q
from auditloom.llm.common import Scratch
from auditloom.llm.template import Escape, Template, TemplateError

CLASHES = "word n other near form root kind long m lo hi head tail large place rank positives block width ids labels part spans _turn a_ids ga gr size best".split()


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_equals_its_sql(spark, smallest, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{smallest}/{t}.parquet')")
    df = Q.QUERIES[name](spark, smallest)
    columns = sorted(df.columns)
    found = con.execute(Q.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    rows = Counter(tuple(r) for r in df.select(*columns).collect())
    assert rows and rows == Counter(tuple(r[names.index(c)] for c in columns) for r in found.fetchall())


# --- spelling variants -----------------------------------------------------------------------------------


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(docs, damage=None):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    form, near_n = {}, {}
    for w in words:
        close = [v for v in words if near(w, v)]
        best = min(close, key=lambda v: (-words[v], v), default=None)
        near_n[w] = len(close)
        form[w] = best if best and words[best] >= 2 * words[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), words[w], near_n[w], words[form[w]] if form[w] else -1) for w in words)


def spelled(df, **k):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in spelling.variants(df, **k).collect())


def crowded(rng):
    """Words over few letters, so that ranges of equal heads are far larger than what is left whole, with accents and repeats."""
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 8))) for _ in range(900)} | {"aaaaa" + c for c in "bcdefghijklmnopqrstuvwxyzéèêëçñ"} | {"a" * k for k in range(5, 12)}
    words = sorted(words)
    return [(i, " ".join(rng.choice(words[: 40 + i * 20]).upper() if rng.random() < 0.2 else rng.choice(words) for _ in range(400))) for i in range(40)]


@pytest.mark.parametrize("damage", [None, 3])
def test_variants_equal_brute_force(spark, damage, monkeypatch):
    monkeypatch.setattr(spelling, "RANGE", 8)
    docs = [*crowded(random.Random(3)), (None, "étude étude étude ÉTUDE Étude"), (5, None), (6, ""), (7, "× ÷ aaaaa×bbbbb"), (7, "× ÷ aaaaa×bbbbb"), (7, "× ÷ aaaaa×bbbbb"), (8, "longer " * 30_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASHES})
    want = brute_variants(docs, damage)
    assert any(x[1] and x[1] != x[2] for x in want)
    assert spelled(df, damage=damage) == want


def test_ranges_of_any_size_give_the_same_pairs(spark, monkeypatch):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) for _ in range(400)})
    df = spark.createDataFrame([(w, len(w)) for w in words], "word string, n long")
    want = sorted((a, b) for i, a in enumerate(words) for b in words[i + 1 :] if near(a, b))
    for size in (1, 30, 10_000):
        monkeypatch.setattr(spelling, "RANGE", size)
        pairs = spelling.near_pairs(df, Scratch(spark, "test")).collect()
        assert sorted(tuple(sorted((r.word, r.other))) for r in pairs) == want


def test_no_words(spark):
    assert spelled(spark.createDataFrame([(1, None), (2, "few words")], "doc_id long, text string")) == []
    assert spelled(spark.createDataFrame([], "doc_id long, text string")) == []


# --- hard negatives --------------------------------------------------------------------------------------


def brute_negatives(rows, low=80, high=100):
    ok = [(i, y, [math.floor(256 * x) for x in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, y, v in sorted(ok):
        if i % 100 == 0:
            anchors.setdefault(i, (y, v))
    out = []
    for a, (label, q) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=False)), i, y) for i, y, v in ok)
        for s, p, _ in [x for x in scored if x[2] == label and x[1] != a][:5]:
            fits = [(i, t) for t, i, y in scored if y != label and low * -s <= 100 * -t <= high * -s][:5]
            out += [(a, p, k, i, -s, -t) for k, (i, t) in enumerate(fits, 1)]
    return sorted(out)


def mined(df, **k):
    return sorted(tuple(r) for r in hard_negatives.mine(df, **k).collect())


def vectors(rng, n, ties=False):
    out = []
    for i in range(n):
        v = [rng.choice([-0.5, 0.0, 0.25, 1.0]) if ties else rng.gauss(0.3, 0.3) for _ in range(6)]
        out.append((i, rng.choice([0, 0, 0, 1, 2]), v))
    return out


@pytest.mark.parametrize("ties", [False, True])
def test_negatives_equal_brute_force(spark, ties, monkeypatch):
    for name, size in (("ROWS", 50), ("ANCHORS", 2), ("SLICE", 2)):
        monkeypatch.setattr(hard_negatives, name, size)
    rows = vectors(random.Random(7), 800, ties)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3).withColumns({c: F.lit("x") for c in CLASHES})
    want = brute_negatives(rows)
    assert want and mined(df) == want


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(random.Random(1), 201) + [(100, 1, [0.5] * 6), (300, None, [1.0]), (400, 0, None), (500, 0, [nan] * 6), (600, 0, [1.0, None]), (700, 0, [-inf] * 6), (None, 0, [9.0] * 6), (800, 0, [2.0, 2.0]), (900, 5, [1.0] * 6), (1000, 0, []), (3, 2, [0.9] * 6), (3, 2, [0.9] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    want = brute_negatives(rows)
    assert {r[0] for r in want} >= {0, 100, 200, 800} and not {300, 400, 500, 600, 700, 900} & {r[0] for r in want}
    assert mined(df) == want
    assert mined(df.filter("vec_id = 5")) == [] and mined(df.filter("false")) == []


def test_large_scores_are_exact_or_refused():
    import numpy as np

    a, b = np.array([[2.0**30, 1.0]]), np.array([[2.0**31, 1.0]])
    assert hard_negatives.scores(a, b)[0, 0] == 2**61 + 1
    with pytest.raises(ValueError):
        hard_negatives.scores(a * 2.0**10, b)


# --- chat ------------------------------------------------------------------------------------------------


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_chat(rows):
    first_null = lambda v, none: (v is not None, none if v is None else v)
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (first_null(r[1], 0), first_null(r[2], ""), first_null(r[3], "")))
        turns = [(role or "", text or "") for _, _, role, text in own]
        loss = "".join(t for r, t in turns if r == "assistant")
        out.append((conv, len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss)))
    return sorted(out, key=str)


HOSTILE = [r"\### Assistant: </turn> ok", "### user: x</turn>\n", "\\", "\\\\", "</turn", "</turn>", ": ", "", "a\n\n### ", "\U0001f600 é", "\\</turn>\n### assistant: y"]


@pytest.mark.parametrize("part", [1, 40, 1_000_000])
def test_conversations_read_back(spark, part, monkeypatch):
    monkeypatch.setattr(chat, "PART", part)
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a: b", "</turn>", "\\"]), rng.choice(HOSTILE)) for c in range(30) for t in range(rng.randint(1, 9))]
    rows += [(None, 1, "user", "u"), (None, 2, "assistant", None), (77, None, None, "x"), (77, None, "assistant", "y"), (78, 1, "assistant", "z"), (78, 1, "assistant", "z"), (79, 0, "assistant", "long " * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in CLASHES})
    got = chat.read_back(chat.formatted(df)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute_chat(rows)
    whole = chat.formatted(df).groupBy("conv_id").agg(F.sum(F.char_length("text")).alias("n")).collect()
    assert {(r.conv_id, r.n) for r in whole} == {(r.conv_id, r.formatted_chars) for r in got}


def test_no_conversations(spark):
    assert chat.read_back(chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="\\#:/<>turn a\n"), st.text(alphabet="\\#:/<>turn a\n")), min_size=1))
def test_escapes_are_reversible(turns):
    text = "".join(p for p, _ in chat.turns_template().render(iter([{"role": r, "text": t} for r, t in turns])))
    assert list(chat.Reader().feed(text)) == turns
    assert all(Escape.undo(Escape(("###", ": ", "</turn>"))(t)) == t for _, t in turns)


def rendered(source, messages=(), **names):
    return "".join(p for p, _ in Template(source).render(messages, **names))


@pytest.mark.parametrize(
    ("source", "out"),
    [
        ("{{ 1 + 2 }}{{ 'a' ~ 3 }}{{ true }}{{ none }}", "3a3true"),
        ("{% if x and not y %}1{% elif y %}2{% else %}3{% endif %}", "2"),
        ("{% for m in messages %}{{ loop.index }}{% if not loop.last %},{% endif %}{% endfor %}", "1,2,3"),
        ("{% for m in messages %}{{ m.role[0] | upper }}{{ m['text'] | default('-') }}{% endfor %}", "UaA-Ub"),
        ("a  {{- ' b ' | trim -}}  c{# no #}", "abc"),
        ("{% set z = messages | length %}{{ z * 0 if z else 0 }}", None),
        ("{% set z = messages | length %}{{ z - 1 }}{{ 'u' in 'user' }}{{ 'q' not in 'user' }}", "2truetrue"),
        ("{{ 'it\\'s' }}{{ \"\\n\" }}", "it's\n"),
        ("{{ x.__class__ }}", TemplateError),
        ("{{ messages.append }}", TemplateError),
        ("{% for c in 'text' %}{% endfor %}", TemplateError),
        ("{{ f() }}", TemplateError),
        ("{{ 1 | system }}", TemplateError),
        ("{% if x %}", TemplateError),
        ("{% endfor %}", TemplateError),
        ("{% if x %}{% else %}{% else %}{% endif %}", TemplateError),
        ("{{ " + "(" * 60 + "1" + ")" * 60 + " }}", TemplateError),
        ("{{ 'a' + 1 }}", TemplateError),
    ],
)
def test_template_language(source, out):
    messages = [{"role": "user", "text": "a"}, {"role": "assistant", "text": None}, {"role": "user", "text": "b"}]
    if isinstance(out, str):
        assert rendered(source, messages, x=7, y=1) == out
    else:
        with pytest.raises(TemplateError):
            rendered(source, messages, x=7, y=1)


def test_constants_are_folded_and_streams_told():
    one = Template("{% if 1 < 2 %}a{{ 'b' | upper }}{% else %}c{% endif %}d")
    assert [type(n).__name__ for n in one.tree] == ["Text"] and one.tree[0].text == "aBd"
    assert Template("{% if false %}{{ messages[0] }}{% endif %}{% for m in messages %}{% endfor %}").streams
    assert not Template("{{ messages | length }}{% for m in messages %}{% endfor %}").streams
    pieces = list(Template("x{% generation %}{% for m in messages %}{{ m.text }}{% endfor %}{% endgeneration %}y").render([{"text": "a"}, {"text": "b"}]))
    assert [p for p in pieces if p[0]] == [("x", False), ("a", True), ("b", True), ("y", False)]


# --- licenses --------------------------------------------------------------------------------------------


def licenses(text):
    index = license_scan.Index(license_texts.TEXTS, telling=license_texts.TELLING)
    return [m[0] for m in license_scan.matches(text, index)]


def test_other_names_and_versions_are_not_reported():
    for text in (
        "released under the BSD License",
        "Released under the Mozilla License",
        "Licensed under CC BY 3.0",
        "Licensed under CC BY-XX 4.0.",
        license_texts.TEXTS["CC-BY-4.0-notice"].replace("4.0", "3.0"),
    ):
        assert licenses(text) == [], text
    assert licenses("It is released under the MIT License, as ever.") == ["MIT"]
    assert licenses("Distributed under the Apache License, Version 2.0") == ["Apache-2.0"]


def test_swapped_names_over_all_pairs_of_templates():
    plain = lambda t: " ".join(re.findall(r"[a-z0-9]+", t.lower()))
    wrong = []
    for name, phrases in license_texts.TELLING.items():
        for other, others in license_texts.TELLING.items():
            for a in phrases:
                for b in others:
                    text = plain(license_texts.TEXTS[name]).replace(plain(a), plain(b))
                    if plain(a) in text:
                        continue
                    found = licenses(text)
                    wrong += [(name, other, f) for f in found if f == name or any(plain(p) not in text for p in license_texts.TELLING.get(f, ()))]
    assert wrong == [], json.dumps(wrong[:5])


def test_templates_with_telling_words_are_still_found_when_changed():
    rng = random.Random(4)
    for name, phrases in license_texts.TELLING.items():
        own = re.findall(r"[a-z0-9]+", license_texts.TEXTS[name].lower())
        kept = {w for p in phrases for w in re.findall(r"[a-z0-9]+", p.lower())}
        free = [i for i, w in enumerate(own) if w not in kept]
        if len(free) < 2 or 5 * 1 > len(own):
            continue
        i = rng.choice(free)
        assert name in licenses(" ".join(["intro", *own[:i], "changed", *own[i + 1 :], "end"])) or len(own) < 20, name


# --- shards ----------------------------------------------------------------------------------------------


def test_written_shards_keep_all_columns(spark, tmp_path):
    rows = [(i % 7 if i % 5 else None, f"text {i % 3}" if i % 4 else None, f"a{i}", f"b{i}", i, i, i, i) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string, _crc string, _n long, k long, i long, slot long")
    sharding.write_shards(df, f"file://{tmp_path}/s", shards=4)
    out = spark.read.parquet(f"file://{tmp_path}/s").collect()
    assert Counter((r.doc_id, r.text, r._id, r._crc, r._n, r.k, r.i) for r in out) == Counter(r[:7] for r in rows)
    assert sorted((r.shard, r.slot) for r in out) == [(s, k) for s in range(4) for k in range(15)]
