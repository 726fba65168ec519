"""Spelling variants: words of a corpus that differ by one code point, and the form that each is a variant of.

Two words that differ by one inserted, deleted or replaced code point agree in the half that the edit leaves alone. A
dictionary sorted by the words' beginnings and one sorted by their ends therefore hold every such pair in a range of equal
heads. Ranges with many words are cut again: the edit lies in one half of what is left, so the other half must agree too.
A merge join sorts the dictionaries and scans the ranges; each pair that meets is verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import Scratch

#: Words are runs of these letters.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Least code points and occurrences of a word, and how much more frequent its form is.
LENGTH, COUNT, RATIO = 5, 3, 2
#: Ranges with more words are cut in two, as long as more than one place of the edit is left.
RANGE = 64
#: Distinct words that a task counts before it passes them on.
HELD = 100_000

_KEY = ["kind", "m", "lo", "hi", "head", "tail"]


def _runs(doc_id: str | None, text: str | None, damage: int | None) -> Counter:
    """Words of one text with their counts, A-Z lower-cased."""
    counts = Counter(RUN.findall((text or "").encode("utf-8", "replace").lower().decode("utf-8")))
    if not damage:
        return counts
    start, out = zlib.crc32(f"{doc_id or ''}:".encode()), Counter()
    for run, n in counts.items():
        h = zlib.crc32(run.encode(), start)
        at = h % len(run)
        out[run if h % damage else run[:at] + run[at + 1 :]] += n
    return out


def counts(docs: DataFrame, damage: int | None = None) -> DataFrame:
    """word and n, its occurrences in the whole texts of docs (doc_id, text). A null text has none.

    damage: where it divides the crc32 of "<doc_id>:<word>", the word loses a code point, so that corpora without spelling
    errors have some; a null doc_id is an empty one there.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        table = lambda: pd.DataFrame({"word": list(held), "n": list(held.values())})
        for b in batches:
            for i, text in zip(b.doc_id, b.text, strict=True):
                held.update(_runs(i, text, damage))
                if len(held) > HELD:
                    yield table()
                    held.clear()
        if held:
            yield table()

    each = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n"))


def _places(words: DataFrame) -> DataFrame:
    """Each word as the shorter and the longer one of a pair, with all places where the edit may be.

    m is the number of code points of the pair's shorter word. Kind S (replaced) has the places 0 to m - 1, kind I (one more
    code point in the longer word) 0 to m.
    """
    length = F.char_length("word")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(long).alias("long"), (length - less).alias("m"), F.lit(0).alias("lo"), (length - top).alias("hi")) for k, long, less, top in (("S", False, 0, 1), ("I", False, 0, 0), ("I", True, 1, 1))])
    return words.select("word", "n", F.inline(kinds))


def _halves(rows: DataFrame) -> DataFrame:
    """Each row with the lower and with the upper half of its places, and what must agree then: a beginning and an end."""
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    two = F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct((middle + 1).alias("lo"), F.col("hi").alias("hi")))
    cut = rows.select("word", "n", "kind", "long", "m", F.inline(two))
    last = F.when(F.col("kind") == "S", F.col("m") - 1).otherwise(F.col("m"))
    return cut.withColumn("head", F.left("word", F.col("lo"))).withColumn("tail", F.right("word", last - F.col("hi")))


def near_pairs(words: DataFrame, scratch: Scratch) -> DataFrame:
    """word, n, other, other_n: each pair of distinct words (word, n) that differ by one code point, once.

    A range that is left at one place holds words that agree in all but one code point, or all but one more: as many as
    the alphabet allows. So no range grows with the corpus, and each pair lies in one range: a replaced code point has one
    place, and of the places where an insertion gives the longer word, the last one counts.
    """
    level, ranges = _halves(_places(words)), []
    while True:
        sizes = level.groupBy(*_KEY).agg(F.count_if(~F.col("long")).alias("short"), F.count_if("long").alias("longer"))
        large = sizes.filter((F.col("short") + F.col("longer") > RANGE) & (F.col("lo") < F.col("hi"))).select(*_KEY, F.lit(True).alias("large"))
        level = scratch.write(level.join(large, _KEY, "left"))
        ranges.append(level.filter(F.col("large").isNull()).drop("large"))
        rest = level.filter("large").drop("large")
        if rest.isEmpty():
            break
        level = _halves(rest)
    every = ranges[0]
    for r in ranges[1:]:
        every = every.unionByName(r)
    a = every.filter(~F.col("long")).drop("long")
    b = every.filter((F.col("kind") == "S") | F.col("long")).select(*_KEY, F.col("word").alias("other"), F.col("n").alias("other_n"))
    upto = F.col("hi") + 1
    once = F.when(F.col("kind") == "S", F.col("word") < F.col("other")).otherwise((F.col("hi") == F.col("m")) | (F.left("word", upto) != F.left("other", upto)))
    return a.join(b, _KEY).filter(once & (F.levenshtein("word", "other", 1) == 1)).select("word", "n", "other", "other_n")


def forms(words: DataFrame, pairs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n: the most frequent near word (of equal ones the first in code-point order), if it is ratio times as frequent."""
    ends = F.array(*[F.struct(F.col(a).alias("word"), F.col(b).alias("near"), F.col(n).alias("near_n")) for a, b, n in (("word", "other", "other_n"), ("other", "word", "n"))])
    best = pairs.select(F.inline(ends)).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(best, "word", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)).cast("long"))
    frequent = lambda c: F.when(-F.col("best.less") >= ratio * F.col("n"), c)
    return joined.select("word", "n", "n_near", frequent(F.col("best.near")).alias("form"), frequent(-F.col("best.less")).alias("form_n"))


def roots(formed: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root for the words of formed (word, form) that have a form: where their forms lead to in the end.

    Each round doubles the steps taken. A form is at least twice as frequent, so that chains are short and have an end.
    """
    step = scratch.write(formed.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    while True:
        further = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = scratch.write(step.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        scratch.drop(step)
        if moved.filter("moved").isEmpty():
            return moved.drop("moved")
        step = scratch.write(moved.drop("moved"))
        scratch.drop(moved)


def variants(docs: DataFrame, damage: int | None = None, least_length: int = LENGTH, least_count: int = COUNT, ratio: int = RATIO) -> DataFrame:
    """Words of docs (doc_id, text) with the form each is a variant of: word, form, root, n, n_near, form_n.

    Words have least_length code points and least_count occurrences at least. n_near counts the words one code point
    away. root is where the forms lead to, the word itself without one. Null and empty texts hold no words, repeated rows
    count each, long texts are read whole. Other columns of docs are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    size: Column = F.char_length("word")
    words = scratch.write(counts(docs, damage).filter((size >= least_length) & (F.col("n") >= least_count)))
    formed = scratch.write(forms(words, near_pairs(words, scratch), ratio))
    scratch.clear(formed)
    ends = roots(formed, scratch)
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
