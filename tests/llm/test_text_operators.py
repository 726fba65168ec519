"""The text operators against brute force, round trips and held-out rows, and on rows that are out of the ordinary."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.llm import fingerprints, langid, license_scan, mixing, near_dedup, packing, quality_model, quality_rules, sharding, toxicity
from auditloom.llm import queries as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CATEGORIES = ["insult", "contempt", "toxic"]
#: Columns that operators use inside.
CLASHES = "size class rank bucket copies whole extra target taken u w s at g g1 g2 h sig rep id a b band component kept n x0 m0 shard slot part block mark range form leader _copy found votes fold y".split()


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty texts, repeated rows and ids, a long text, wide characters, and columns with names used inside."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, "one two three four five six seven", "en", "s1"),
        (1, "one two three four five six seven", "en", "s1"),
        (1, "another text with the same number", "en", "s1"),
        (None, "one two three four five six seven", None, None),
        (None, None, None, None),
        (2, None, "en", "s1"),
        (3, "", "en", None),
        (4, " \t\n ", None, "s2"),
        (5, "42 !! 17", "de", "s2"),
        (6, "Grüße aus Köln \U0001f600 ﬁn", "de", "s2"),
        (7, long, "en", "s1"),
        (8, "same line\nsame line\nsame line", "en", "s3"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit("x") for c in CLASHES})


def chain(spark):
    docs = spark.createDataFrame([(i, f"you idiot number {i}" if i % 2 else f"a fine day {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    return toxicity.train(toxicity.labelled(docs, labels), CATEGORIES)


ROW_BY_ROW = {
    "near": lambda s, d: near_dedup.near_duplicates(d),
    "toxicity": lambda s, d: toxicity.score(d, chain(s)),
    "mix": lambda s, d: mixing.mix(d),
    "langid": lambda s, d: langid.identify(d, langid.prototypes(d.select("text", "lang"))),
    "rules": lambda s, d: quality_rules.judge(d),
    "exact": lambda s, d: fingerprints.exact_groups(d),
    "quality": lambda s, d: quality_model.quality(d),
    "shard": lambda s, d: sharding.shard(d),
}


@pytest.mark.parametrize("name", ROW_BY_ROW)
def test_odd_rows_each_have_a_result(spark, odd, name):
    out = ROW_BY_ROW[name](spark, odd).collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in odd.select("doc_id").collect())


@pytest.mark.parametrize("name", [*ROW_BY_ROW, "pack", "scan", "good", "clean", "mixed"])
def test_an_empty_table_gives_an_empty_result(spark, odd, name):
    more = {"pack": lambda s, d: packing.pack(d, Q.tokenizer_path()), "scan": lambda s, d: license_scan.scan(d), "good": lambda s, d: quality_model.good(d), "clean": lambda s, d: toxicity.clean(d, chain(s)), "mixed": lambda s, d: mixing.mixed(d)}
    assert (ROW_BY_ROW | more)[name](spark, odd.filter("false")).count() == 0


def test_filters_keep_all_columns(spark, odd):
    for out in (quality_model.good(odd), toxicity.clean(odd, chain(spark)), mixing.mixed(odd)):
        assert out.columns == odd.columns
        out.count()


# --- 1 ---------------------------------------------------------------------------------------------------


def shingles(text, k):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(text)]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[n + 1 :]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return {i: (len(s), top(i)) for i, s in sets}


def near_copies(rng, groups, members, edits):
    rows, vocabulary = [], [f"word{i}" for i in range(3000)]
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 250))]
        for _ in range(members):
            t = list(base)
            for _ in range(rng.randint(0, edits)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            rows.append(" ".join(t).title() if rng.random() < 0.3 else "  ".join(t))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("groups,members,edits", [(12, 12, 8), (1, 150, 14)])
def test_near_duplicates_are_the_components_of_all_pairs(spark, monkeypatch, groups, members, edits):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)  # several blocks for each bucket
    rows = near_copies(random.Random(groups), groups, members, edits)
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(rows, 4, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_near_duplicates_of_texts_beyond_the_small_sets(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SET", 32)
    rows = near_copies(random.Random(5), 2, 30, 12)
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(rows, 4, 80)


def test_rows_that_repeat_a_doc_id_are_grouped_by_their_own_text(spark):
    t = ["a b c d e f g h i j", "k l m n o p q r s t", "a b c d e f g h i j x", ""]
    rows = [(3, t[0]), (5, t[1]), (5, t[0]), (5, t[2]), (5, t[3]), (3, t[3]), (None, t[0]), (5, t[1])]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in out) == [(0, 7, 0), (3, 0, 3), (3, 7, 3), (5, 0, 5), (5, 7, 3), (5, 7, 5), (5, 7, 5), (5, 8, 3)]


def test_one_text_of_each_group_stays_where_ids_repeat_or_lack(spark):
    t = ["a b c d e f g h i j", "k l m n o p q r s t", "a b c d e f g h i j x", ""]
    rows = [(3, t[0]), (5, t[1]), (5, t[0]), (7, t[2]), (8, t[3]), (9, None), (None, t[0]), (5, t[1]), (None, "u v w x y z"), (None, "u v w x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in [*CLASHES, "node", "first_id", "_key"]})
    out = near_dedup.without_near_copies(df, 4, 80)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == [(0, "u v w x y z"), (3, t[0]), (5, t[1]), (8, ""), (9, "")]


def test_one_of_different_near_copies_with_one_id_stays(spark):
    rows = [(5, "a b c d e f g h i j"), (5, "a b c d e f g h i j x"), (6, "a b c d e f g h i j"), (2, "other words are here now")]
    out = near_dedup.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()
    assert sorted(r.doc_id for r in out) == [2, 5]


def test_texts_without_words_are_not_linked(spark):
    df = spark.createDataFrame([(3, ""), (1, None), (2, " \t"), (4, "a b"), (5, "A B")], "doc_id long, text string")
    out = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, 4, 80).collect()}
    assert out == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4}


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**64, 800, dtype=np.uint64), rng.integers(0, 2**64, 200, dtype=np.uint64)
    union = np.concatenate([a, b])
    x, y = near_dedup.registers(a), near_dedup.registers(union)
    assert (np.maximum(x, near_dedup.registers(b)) == y).all()
    assert abs(near_dedup.estimate(x[None], y[None], np.array([800]), np.array([1000]))[0] - 0.8) < 0.1


# --- 2, 4, 7: held-out rows --------------------------------------------------------------------------------


def test_toxicity_on_documents_that_it_was_not_fitted_on(spark, small):
    docs, labels = Q.read_table(spark, small, "documents"), Q.read_table(spark, small, "labels")
    odd_ids = labels.filter("doc_id % 2 = 1")
    fitted = toxicity.train(toxicity.labelled(docs, odd_ids), CATEGORIES)
    rows = toxicity.score(docs, fitted).join(labels.filter("doc_id % 2 = 0 and toxic is not null"), "doc_id").select("toxic", "toxic_pred").collect()
    assert np.mean([r.toxic == r.toxic_pred for r in rows]) >= 0.95


def test_categories_do_not_depend_on_listed_words(spark):
    """Two kinds of toxic documents in an invented vocabulary: each category finds one of them, and no clean document."""
    rng = random.Random(3)
    kinds = (["zorbal", "quimp", "frandel"], ["veshtu", "okrim", "plundat"])
    rows = []
    for i in range(900):
        own = rng.choices(["day", "house", "river", "stone", "letter", "window", "garden"], k=12)
        rows.append((i, " ".join(own + (rng.sample(kinds[i % 3], 2) if i % 3 < 2 else []))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 < 2)) for i in range(900)], "doc_id long, toxic int")
    scores = toxicity.score(docs, toxicity.train(toxicity.labelled(docs, labels), CATEGORIES)).collect()
    means = {(c, k): np.mean([r[f"p_{c}"] for r in scores if r.doc_id % 3 == k]) for c in CATEGORIES for k in range(3)}
    assert abs(means["insult", 0] - means["insult", 1]) > 0.6 and abs(means["contempt", 0] - means["contempt", 1]) > 0.6
    assert all(means[c, 2] < 0.3 for c in CATEGORIES) and min(means["toxic", 0], means["toxic", 1]) > 0.7


def test_later_models_see_out_of_fold_probabilities():
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(50, 12, replace=False)) for _ in range(600)]
    first = np.array([int(7 in r) for r in rows])
    fitted = toxicity.fit_chain(rows, np.column_stack([first, first]), ["a", "b"], np.arange(600) % 3)
    assert fitted.models[1].extra.shape == (1,)
    assert fitted.models[1].extra[0] > 0


def test_language_of_held_out_documents(spark, small):
    docs = Q.read_table(spark, small, "documents").select("doc_id", "lang")
    rows = Q.op4_language_id(spark, small).join(docs, "doc_id").filter("held_out and lang is not null and lang_pred != 'und'").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_bundles_add_bound_and_permuted_letters():
    v, text = langid.Vectors(), "abca bca"
    total, codes = np.zeros(langid.WIDTH), langid.letter_codes(text)
    for i in range(len(codes) - 2):
        x = [v.letter(int(c)).astype(int) for c in codes[i : i + 3]]
        total += np.roll(x[0], 2) * np.roll(x[1], 1) * x[2]
    assert (v.bundles([langid.grams(codes), langid.grams(codes)]) == total).all()


def test_prototypes_of_many_partitions_add_up(spark):
    df = spark.createDataFrame([(f"text number {i} abc", "xy"[i % 2]) for i in range(60)], "text string, lang string")
    one, many = langid.prototypes(df.coalesce(1)), langid.prototypes(df.repartition(9))
    assert all((one[k] == many[k]).all() for k in "xy")


def test_label_model_finds_the_accuracies():
    rng = np.random.default_rng(0)
    n, right = 20_000, np.linspace(0.7, 0.95, len(quality_model.NAMES))
    bad = rng.random(n) < 0.3
    agree = rng.random((n, len(right))) < right
    letters = np.where(agree == bad[:, None], "b", "g")
    weak, table, share = quality_model.label_model(Counter("".join(r) for r in letters))
    assert abs(share - 0.3) < 0.03
    assert np.abs(table[1, :, 1] - right).max() < 0.06
    assert np.mean([(weak["".join(r)] > 0.5) == y for r, y in zip(letters, bad, strict=True)]) > 0.93


def test_quality_against_labels_that_it_never_saw(spark, small):
    rows = Q.op7_quality_classifier(spark, small).join(Q.read_table(spark, small, "labels"), "doc_id").filter("quality is not null").collect()
    assert np.mean([r.quality == r.kept for r in rows]) >= 0.95


# --- 3 ---------------------------------------------------------------------------------------------------


def test_fewest_distinct_words_of_all_spans():
    rng = np.random.default_rng(5)
    for n, span, kinds in [(0, 4, 3), (1, 4, 3), (4, 4, 3), (5, 4, 2), (60, 7, 5), (200, 40, 30), (200, 40, 500)]:
        own = rng.integers(0, kinds, n).astype(np.uint64)
        assert quality_model.fewest(own, span) == min(len(set(own[i : i + span].tolist())) for i in range(max(1, n - span + 1)))


@pytest.mark.parametrize("clean_words", [400, 650, 5_000])
def test_a_looping_tail_is_seen_wherever_it_starts(clean_words):
    fewness = quality_model.NAMES.index("fewness")
    clean = " ".join(f"word{i}" for i in range(clean_words))
    loop = " ".join(["read more about our offers on this page today"] * 60)
    assert quality_model.votes(quality_model.examine(clean)[1])[fewness] == "g"
    for text in (f"{clean} {loop}", f"{loop} {clean}", f"{clean} {loop} {clean}"):
        assert quality_model.votes(quality_model.examine(text)[1])[fewness] == "b"


def test_mixture_meets_its_targets(spark, small):
    docs = {r.doc_id: r for r in Q.read_table(spark, small, "documents").collect()}
    out = Q.op3_mixing(spark, small).collect()
    by = defaultdict(list)
    for r in out:
        assert r.size == len(words(docs[r.doc_id].text))
        assert r.taken <= 3 * r.size
        by[docs[r.doc_id].source].append(r)
    total, order = sum(r.size for r in out), sorted(by, key=lambda s: (s is None, s or ""))
    size = {s: sum(r.size for r in by[s]) for s in order}
    left, open_, target = float(total), {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {}
    while open_:
        weight = sum(open_.values())
        full = [s for s in open_ if left * open_[s] / weight > 3 * size[s]]
        if not full:
            target |= {s: left * w / weight for s, w in open_.items()}
            break
        for s in full:
            target[s] = 3.0 * size[s]
            open_.pop(s)
        left = total - sum(target.values())
    for s in order:
        longest = max(r.size for r in by[s])
        assert abs(sum(r.taken for r in by[s]) - target[s]) <= longest
        assert {r.source_size for r in by[s]} == {size[s]}
        assert abs(by[s][0].target - target[s]) < 1e-6 * max(target[s], 1)
    assert sorted(map(tuple, out)) == sorted(map(tuple, Q.op3_mixing(spark, small).collect()))


def in_pareto_order(rows, target, most=3):
    """Copies of the rows (doc_id, size, u) of one source, in Python: whole copies, then the lowest ranks while they fit."""
    rows = [r for r in rows if r[1]]
    words = Counter()
    for _, size, _ in rows:
        words[size.bit_length() - 1] += size
    low, high = 0.0, 1e6
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(most, level * 2 ** (-c / 8)) * w for c, w in words.items()) < target else (low, level)
    expected = {c: min(most, high * 2 ** (-c / 8)) for c in words}
    expected = {c: round(x) if abs(x - round(x)) < 1e-9 else x for c, x in expected.items()}
    copies, ranked = {}, []
    for i, size, u in rows:
        whole, p = divmod(expected[size.bit_length() - 1], 1)
        copies[i] = int(whole)
        if p:
            q = u / (1 - u) / (p / (1 - p))
            ranked.append((q / (1 + q), i, size))
    left, start = target - sum(copies[i] * size for i, size, _ in rows), 0
    for _, i, size in sorted(ranked):
        copies[i] += start + size / 2 <= left
        start += size
    return copies


def test_documents_are_taken_in_pareto_order(spark, smallest):
    docs = Q.read_table(spark, smallest, "documents")
    u = {r.doc_id: r for r in docs.select("doc_id", "source", mixing.uniform(11, F.col("doc_id").cast("long"), F.col("text")).alias("u")).collect()}
    out, by = Q.op3_mixing(spark, smallest).collect(), defaultdict(list)
    for r in out:
        by[u[r.doc_id].source].append(r)
    for rows in by.values():
        want = in_pareto_order([(r.doc_id, r.size, u[r.doc_id].u) for r in rows], rows[0].target)
        assert {r.doc_id: r.copies for r in rows if r.size} == want


@pytest.mark.parametrize("sizes", [[16] * 93 + [17] * 4, [16], [5] * 3, [1, 2, 4, 8, 16, 900], [7] * 1000])
def test_a_source_that_is_its_own_target_is_taken_once(spark, sizes):
    df = spark.createDataFrame([(i, " ".join(["w"] * n), "s") for i, n in enumerate(sizes)], "doc_id long, text string, source string")
    out = mixing.mix(df).collect()
    assert abs(sum(r.taken for r in out) - sum(sizes)) <= max(sizes) / 2
    if len({n.bit_length() for n in sizes}) == 1:
        assert all(r.copies == 1 for r in out)


def test_sources_of_one_size_class_keep_to_their_targets(spark):
    rng = random.Random(8)
    rows = [(1000 * s + i, " ".join(["w"] * rng.choice([16, 17, 30])), f"s{s:02}") for s in range(40) for i in range(rng.randint(1, 60))]
    by = defaultdict(list)
    for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        by[r.doc_id // 1000].append(r)
    assert all(abs(sum(r.taken for r in own) - own[0].target) <= 15.001 for own in by.values())


# --- 5 ---------------------------------------------------------------------------------------------------


def base_counts(text):
    text = text or ""
    w = words(text)
    lines, seen, dup = [x for x in text.split("\n") if words(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_counts_of_whole_texts(spark, small, odd):
    for docs in (Q.read_table(spark, small, "documents"), odd):
        texts = sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=str)
        want = Counter((i, *base_counts(t)) for i, t in texts)
        out = quality_rules.judge(docs).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out) == want
        assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in out)
        assert not any(r.kept and r.base_failed for r in out)


def test_outliers_of_a_group_are_rejected(spark):
    rng = random.Random(2)
    plain = [(i, " ".join(f"{rng.choice('abcdef')}{'x' * rng.randint(1, 8)}{rng.randint(0, 999)}" for _ in range(rng.randint(80, 200))), "en", "s") for i in range(300)]
    strange = [(1000 + i, " ".join("#$%" + "q" * 40 + str(rng.randint(0, 999)) for _ in range(100)), "en", "s") for i in range(10)]
    out = quality_rules.judge(spark.createDataFrame(plain + strange, "doc_id long, text string, lang string, source string")).collect()
    assert not any(r.kept for r in out if r.doc_id >= 1000)
    assert np.mean([r.kept for r in out if r.doc_id < 1000]) > 0.97


# --- 6 ---------------------------------------------------------------------------------------------------


def test_fingerprints_of_edited_texts(spark, small):
    rows = sorted((r.doc_id, r.text or "") for r in Q.read_table(spark, small, "documents").select("doc_id", "text").collect())
    out = {r.doc_id: r for r in Q.op6_fingerprints(spark, small).collect()}
    assert len(out) == len(rows)
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + after[:half]
        r = out[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprints.fingerprint(t), fingerprints.fingerprint(e))
        assert (r.near_edited, r.near_next) == (float(r.fingerprint == r.edited_fingerprint), float(r.fingerprint == fingerprints.fingerprint(after)))
    least = {}
    for i, t in rows:
        least.setdefault(fingerprints.canonical(t), i)
    assert all(out[i].group_id == least[fingerprints.canonical(t)] for i, t in rows)


def test_copies_in_several_parts_are_one_group(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "COPIES", 3)
    monkeypatch.setattr(fingerprints, "ROWS", 10)
    texts = ["Same  Text", "same text", " SAME TEXT ", "other", "", None]
    rows = [(i, texts[i % 6]) for i in range(120)] + [(None, "same text"), (7, "same text"), (7, "other")]
    out = fingerprints.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    ids = defaultdict(list)
    for i, t in rows:
        ids[fingerprints.canonical(t)].append(i)
    assert Counter((r.doc_id, r.group_id) for r in out) == Counter((i, min(x for x in of if x is not None)) for of in ids.values() for i in of)


def test_canonical_forms():
    assert fingerprints.fingerprint("Straße\t A") == fingerprints.fingerprint("STRASSE a ") != fingerprints.fingerprint("strasse  b")
    assert fingerprints.canonical(None) == fingerprints.canonical(" \n") == b""


# --- 8 ---------------------------------------------------------------------------------------------------


def test_shards_are_exact_and_gapless(spark, small):
    texts = {r.doc_id: r.text or "" for r in Q.read_table(spark, small, "documents").collect()}
    out = Q.op8_sharding(spark, small).collect()
    by = defaultdict(list)
    for r in out:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        by[r.shard].append(r.slot)
    sizes = [len(by[s]) for s in range(16)]
    assert sum(sizes) == len(texts) and max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_shards_do_not_depend_on_partitions_and_are_uniform(spark):
    df = spark.range(1600).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    a, b = sharding.shard(df.coalesce(1), 4, 9).collect(), sharding.shard(df.repartition(7), 4, 9).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    # Of the first 100 ids, each shard gets about 25: a hypergeometric number of standard deviation about 4.2.
    for seed in range(3):
        n = Counter(r.shard for r in sharding.shard(df, 4, seed).collect() if r.doc_id < 100)
        assert all(abs(n[s] - 25) < 18 for s in range(4))


def test_hypergeometric_numbers():
    rng = np.random.default_rng(0)
    x = np.array([sharding.hypergeometric(rng, 30, 100, 20) for _ in range(20_000)])
    assert abs(x.mean() - 6) < 0.05
    assert abs(x.var() - 20 * 0.3 * 0.7 * 80 / 99) < 0.15


# --- 9 ---------------------------------------------------------------------------------------------------


def check_packing(rows, texts):
    tokenizer = packing._tokenizer(Q.tokenizer_path())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, t in texts.items():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    used = padded = 0
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.TOKENS and len(parts) <= packing.SEGMENTS and sum(r.length - 1 for r in parts) <= packing.LOSS
        used += at
        padded += at if at & (at - 1) == 0 else packing.TOKENS
    return used / padded


def test_every_token_lies_in_one_piece(spark, small):
    texts = {r.doc_id: r.text for r in Q.read_table(spark, small, "documents").collect()}
    assert check_packing(Q.op9_packing(spark, small).collect(), texts) > 0.98


def test_odd_texts_are_tokenised_whole(spark):
    texts = dict(enumerate(["", None, " ", "a  b", " lead", "trail ", "x\n\ny", "it's we'll", "<|endoftext|> here", "tab\tbed", "é ü z", "\U0001f600 \U0001f600", "12 345  678", "a" * 5000]))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check_packing(packing.pack(df, Q.tokenizer_path()).collect(), texts)


def test_limits_on_segments_and_loss_bind(spark):
    """Instruction data: prompts bear no loss. Each of the limits is met exactly by some sequence and passed by none."""
    rng = random.Random(12)
    say = lambda n: " ".join(rng.choices(["day", "house", "river", "stone"], k=n))
    rows = [(i, rng.choice([None, "", say(rng.randint(1, 150))]), rng.choice([None, say(rng.randint(1, 90)), "x"])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, prompt string, text string").repartition(2)
    tokenizer = packing._tokenizer(Q.tokenizer_path())
    encode = lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids
    for tokens, segments, loss in ((256, 3, 60), (256, 64, 256), (128, 2, 128)):
        pieces, sequences = defaultdict(list), defaultdict(list)
        for r in packing.pack(df, Q.tokenizer_path(), tokens, segments, loss, "prompt").collect():
            pieces[r.doc_id].append(r)
            sequences[r.sequence_id].append(r)
        silent = {}
        for i, prompt, text in rows:
            ids, at = np.array([*encode(prompt), *encode(text), 1], "<u4"), 0
            silent[i] = max(len(encode(prompt)), 1)
            for r in sorted(pieces[i], key=lambda r: r.start):
                assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
                at += r.length
            assert at == len(ids)
        used = [(sum(r.length for r in x), len(x), sum(max(0, r.start + r.length - max(r.start, silent[r.doc_id])) for r in x)) for x in sequences.values()]
        most = np.array(used).max(axis=0)
        assert (most <= (tokens, segments, loss)).all() and most[0] == tokens
        if segments < 64:
            assert most[1] == segments
        if loss < tokens:
            assert most[2] == loss


@pytest.mark.parametrize("columns", [[], ["start", "length", "text0", "doc_tokens", "offset"]])
def test_packing_of_rows_without_ids_and_with_repeated_ones(spark, columns):
    rows = [(1, "a b"), (1, "a b"), (1, "c"), (None, "d e f"), (None, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in columns})
    out = packing.pack(df, Q.tokenizer_path()).collect()
    tokenizer = packing._tokenizer(Q.tokenizer_path())
    size = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    assert sum(r.length for r in out) == sum(size(t) for _, t in rows)
    assert Counter(r.doc_id for r in out if r.start == 0) == Counter(i for i, _ in rows)


# --- 10 --------------------------------------------------------------------------------------------------


def test_license_scan_finds_changed_notices(spark):
    mit = license_scan.TEMPLATES["MIT-permission"]
    changed = mit.replace("free of charge", "at no cost").replace("any person", "every person")
    far = " ".join(mit.split()[::3])
    df = spark.createDataFrame([(1, "Intro words. " + mit + " More."), (2, changed), (3, far), (4, None), (5, ""), (6, mit + "\n" + mit)], "doc_id long, text string")
    out = license_scan.scan(df).filter("license = 'MIT-permission'").collect()
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    assert sorted(by) == [1, 2, 6] and len(by[6]) == 2
    assert by[1][0].coverage == 1.0 and by[1][0].first_word == 2 and by[1][0].first_char == 13
    assert 0.8 <= by[2][0].coverage < 1


def test_whole_notices_are_compared_and_variants_told_apart():
    index, names = license_scan.Index(license_scan.TEMPLATES), sorted(license_scan.TEMPLATES)
    wanted = "MIT ISC 0BSD BSD-2-Clause BSD-3-Clause Apache-2.0 GPL-2.0 GPL-3.0 LGPL-2.1 LGPL-3.0 AGPL-3.0 MPL-2.0 Unlicense CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0".split()
    assert {f"{n}-notice" for n in wanted} <= set(names)
    for name in names:
        found = license_scan.matches(f"Some words before. {license_scan.TEMPLATES[name]} And after.", index)
        assert [(m[0], m[1], m[2]) for m in found] == [(name, 1.0, 3)], name
    opening, other = license_scan.TEMPLATES["MIT-permission"], " ".join(f"other{i}" for i in range(140))
    assert [m[0] for m in license_scan.matches(f"{opening} {other}", index)] == ["MIT-permission"]


def test_no_match_of_the_least_coverage_is_missed():
    """Each template with each single word changed, left out or doubled, and with several, against alignment on every diagonal."""
    index = license_scan.Index(license_scan.TEMPLATES)
    rng = random.Random(11)
    for t, name in enumerate(index.names):
        own = re.findall(r"[a-z0-9]+", license_scan.TEMPLATES[name].lower())
        edits = [own[:i] + put + own[i + 1 :] for i in range(len(own)) for put in (["changed"], [], [own[i], "more"])]
        edits += [[w for x in own for w in rng.choice([[x], [x], [x], [x], [x, "more"], ["changed"], []])] for _ in range(10)]
        for k, edit in enumerate(edits):
            text = tokens_of(["intro", "words", *edit, "end"])
            around = {d: license_scan.align(index.words[t], text, d, license_scan.BAND) for d in (range(-7, 14) if len(own) < 40 else (2,) if k % 9 == 0 else ())}
            exact = {d for d, (n, _, _) in around.items() if n >= license_scan.LEAST * len(own)}
            assert exact <= {d for u, d in index.diagonals(text) if u == t}, (name, edit)
    for text in ("Released under an MIT license", "Licensed under CC or NC 4.0 Licensed under CC or BY NC 4.0", "Released x under x the x MIT x License"):
        assert license_scan.matches(text, index), text
    assert [m[2:4] for m in license_scan.matches("Released to us. Released under the MIT License.", index)] == [(3, 7)]


def tokens_of(words):
    return license_scan.tokens(" ".join(words))[1]


def test_banded_alignment_is_the_longest_common_subsequence():
    rng = np.random.default_rng(4)
    for _ in range(30):
        a, b = rng.integers(0, 4, 12), rng.integers(0, 4, 12)
        table = np.zeros((13, 13), int)
        for i in range(12):
            for j in range(12):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert license_scan.align(a, b, 0, 12)[0] == table[-1, -1]


# --- pipeline --------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, smallest):
    import corpus_pipeline

    docs = Q.read_table(spark, smallest, "documents")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, smallest)
        assert docs.columns == columns, name
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now and now <= ids
        ids = now
    assert {r.doc_id for r in corpus_pipeline.run(spark, smallest).collect()} == ids


def test_pipeline_on_no_documents(spark, smallest, tmp_path):
    import corpus_pipeline

    for t in ("documents", "labels"):
        Q.read_table(spark, smallest, t).filter("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_ids_are_those_of_the_tokenizer():
    encoder = packing.Encoder(Q.tokenizer_path())
    slow = lambda t: encoder.tokenizer.encode(t, add_special_tokens=False).ids
    assert encoder.words is not None
    around = [f"a{c}b {c}{c} 1{c}  {c}\n" for c in map(chr, range(0x10000)) if c.isspace() or not 0xD800 <= ord(c) < 0xE000 and ord(c) % 7 == 0]
    rng, letters = random.Random(5), " \n\t\x0b\r\x85\xa0 \x1c'slvremtd1a.é日<|endoftext|>\U0001f600"
    mixed = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    for t in [*around, *mixed, " " * 100_000, "\n" * 5000 + "x", "ab" * 50_000]:
        assert slow(t) == encoder.encode(t).tolist()


def test_other_tokenizers_encode_themselves():
    encoder = packing.Encoder(Q.tokenizer_path("word_bpe_49k.json"))
    assert encoder.words is None
    assert encoder.encode("Some words, 12").tolist() == encoder.tokenizer.encode("Some words, 12", add_special_tokens=False).ids
