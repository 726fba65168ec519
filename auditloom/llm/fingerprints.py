"""Canonical exact fingerprints.

A text is brought to a canonical form (NFKC, case folded, runs of white space as one space, none at the ends) and
hashed to 128 bits. Texts with equal hashes fall into one bucket, and inside buckets their canonical bytes are
compared, so that two texts count as equal only if they are.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import Scratch

#: Ranges of doc_id, each sorted on its own: at least so many, and more so that one has about so many rows at most.
RANGES, ROWS = 64, 10_000
#: Copies of a fingerprint that are compared with one copy of the first one's canonical text.
COPIES = 1_000


def canonical(text: str | None) -> bytes:
    """The canonical form as UTF-8; null counts as empty. NFKC is taken again after folding, which may undo it."""
    t = unicodedata.normalize("NFKC", text or "")
    t = unicodedata.normalize("NFKC", t.casefold())
    return " ".join(t.split()).encode("utf-8", "surrogatepass")


def fingerprint(text: str | None) -> str:
    """32 hexadecimal digits."""
    return xxhash.xxh3_128_hexdigest(canonical(text))


def edited(text: str, following: str) -> str:
    """text with its last half of code points (rounded down) replaced by as many first ones of following, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and fingerprint of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id.astype("Int64"), "n_chars": [len(t or "") for t in b.text], "fingerprint": [fingerprint(t) for t in b.text]})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, n_chars long, fingerprint string")


def _in_ranges(rows: DataFrame, starts: list[int]) -> DataFrame:
    """Adds the number of the range that doc_id falls in and whether it is the range's least id, where starts are the least ids of ranges after the first."""
    at = np.array(starts, np.int64)

    @F.pandas_udf("int")
    def number(ids: pd.Series) -> pd.Series:
        x = ids.fillna(-(2**63)).astype("int64").to_numpy()
        found = np.searchsorted(at, x, side="right")
        return pd.Series((2 * found + ((found > 0) & (np.append(at, 0)[found - 1] == x))).astype(np.int32))

    coded = rows.withColumn("range", number(F.col("doc_id")) if starts else F.lit(0))
    return coded.withColumn("opens", F.col("range") % 2 == 1).withColumn("range", F.floor(F.col("range") / 2).cast("int"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """Each row of docs (doc_id, text) beside the row that follows it in the order of doc_id, and its group of copies.

    Returns doc_id, n_chars, fingerprint, edited_sha256, edited_fingerprint, next_fingerprint and group_id, a row for
    each row of docs. After the last row comes the first; a null id comes before all. Rows that repeat a doc_id follow
    in the order of their texts. edited_* belong to the text whose last half is replaced from the following one.
    group_id is the smallest doc_id among documents with the same canonical bytes.

    The texts are shuffled once, into ranges of doc_id that are sorted on their own; the first row of a range also
    goes to the range before. Canonical texts are compared only within buckets of equal hashes, each with the one of
    the bucket's smallest doc_id, which is dealt out with the bucket in parts of about COPIES rows. If they differ despite equal hashes, the documents are grouped by a hash of another
    kind (sha256).
    """
    scratch = Scratch(docs.sparkSession, "exact")
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    prints = scratch.write(fingerprints(own))
    many = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("leader"), F.count("*").alias("n")).filter("n > 1")
    # A bucket of many copies is dealt out in parts, each of which meets its own copy of the first text.
    parts = F.ceil(F.col("n") / COPIES).cast("int")
    marks = prints.join(many, "fingerprint").select("doc_id", F.col("fingerprint").alias("text"), parts.alias("parts")).distinct()

    ranges = max(RANGES, prints.count() // ROWS)
    cuts = prints.agg(F.min("doc_id").alias("least"), F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], max(100_000, 10 * ranges)).alias("at")).first()
    starts = sorted({x for x in cuts["at"] or [] if x > cuts["least"]})
    last = len(starts)
    ranged = _in_ranges(own.withColumn("parts", F.lit(None).cast("int")).unionByName(marks), starts)
    # The least row of range k is also the one after the last row of range k - 1; the very first follows the last.
    first = F.when(F.col("parts").isNotNull(), F.lit(None)).when(F.col("doc_id").isNull() | (F.col("doc_id") <= F.lit(cuts["least"])), F.lit(last)).when(F.col("opens"), F.col("range") - 1)
    homes = F.filter(F.array(F.struct(F.col("range"), F.lit(False).alias("guest")), F.struct(first.alias("range"), F.lit(True).alias("guest"))), lambda h: h["range"].isNotNull())
    dealt = ranged.select("doc_id", "text", "parts", F.explode(homes).alias("h")).select("h.range", "h.guest", "doc_id", "parts", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple | None = None  # the row before, until the one after it is seen
        area, marked, shared, open_ = None, object(), {}, False  # shared: parts of the buckets that marked's texts fall in
        for b in batches:
            out = []
            for rng, guest, doc_id, parts_, text in zip(b.range, b.guest, b.doc_id, b.parts, b.text, strict=True):
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                if rng != area:
                    area, held, marked, open_ = rng, None, object(), True
                if not open_:
                    continue
                if not pd.isna(parts_):
                    if doc_id != marked:
                        marked, shared = doc_id, {}
                    shared[text] = int(parts_)
                    continue
                form = canonical(text)
                mine = xxhash.xxh3_128_hexdigest(form)
                if held is not None:
                    i, t, p, keep, part = held
                    e = edited(t, text)
                    out.append((i, len(t), p, hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint(e), mine, keep, part))
                copied = doc_id == marked and mine in shared
                held = (doc_id, text, mine, form.decode("utf-8", "surrogatepass") if copied else None, xxhash.xxh32_intdigest(str(doc_id)) % shared[mine] if copied else 0)
                open_ = not guest
            yield pd.DataFrame(out, columns=["doc_id", "n_chars", "fingerprint", "edited_sha256", "edited_fingerprint", "next_fingerprint", "form", "part"]).astype({"doc_id": "Int64"})

    kind = "doc_id long, n_chars long, fingerprint string, edited_sha256 string, edited_fingerprint string, next_fingerprint string, form string, part int"
    sorted_ = dealt.repartition(last + 1, "range").sortWithinPartitions("range", "guest", "doc_id", F.col("parts").desc_nulls_last(), "text")
    rows = scratch.write(sorted_.mapInPandas(run, kind))

    forms = rows.filter("form is not null").select("fingerprint", F.col("doc_id").alias("leader"), F.col("form").alias("first_form"))
    leaders = many.join(forms, ["fingerprint", "leader"]).dropDuplicates(["fingerprint"])
    leaders = leaders.select("fingerprint", "leader", "first_form", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    judged = rows.join(leaders, ["fingerprint", "part"], "left")
    equal = F.col("first_form").isNull() | F.coalesce(F.col("form") == F.col("first_form"), F.lit(False))
    judged = judged.select(
        *[c for c in rows.columns if c not in ("form", "part")], F.when(equal, F.coalesce("leader", "doc_id")).alias("group_id"), F.when(~equal, F.sha2("form", 256)).alias("other")
    )
    others = judged.filter("other is not null").groupBy("other").agg(F.min("doc_id").alias("other_id"))
    return judged.join(others, "other", "left").select(*[c for c in rows.columns if c not in ("form", "part")], F.coalesce("group_id", "other_id").alias("group_id"))
