"""Toxicity by a classifier chain.

Categories are predicted one after another by linear models over hashed words and word beginnings. Each model also
gets the probabilities of the categories before it. The narrower categories are two kinds of toxic documents that the
labelled rows show themselves: the features learned from the toxic label are split by the documents they share. In training those are out-of-fold predictions, so that a later
model sees earlier probabilities as uncertain as they are on new documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import Scratch, Words
from auditloom.llm.linear import SAMPLE, Linear, fit, gathered, hashed, sampled

FOLDS = 3
#: Features that tell two kinds of toxic documents apart, at most: those of the largest weights.
TELLING = 300

_LETTERS = np.zeros(256, bool)
_LETTERS[97:123] = True
_LETTERS[128:] = True


def features(text: str | None) -> np.ndarray:
    """Feature numbers of the words of a lower-cased text and of their first 4, 5 and 6 bytes."""
    words = Words((text or "").lower().encode("utf-8", "replace"), _LETTERS)
    if not len(words):
        return np.zeros(0, np.int32)
    return hashed(np.concatenate([words.hashes(), *(words.prefixes(k) for k in (4, 5, 6))]))


class Chain:
    """Models in the order of their categories."""

    def __init__(self, names: list[str], models: list[Linear]):
        self.names, self.models = names, models

    def probabilities(self, text: str | None) -> list[float]:
        found, p = features(text), []
        for m in self.models:
            p.append(m.probability(found, p))
        return p


def fit_chain(rows: list[np.ndarray], labels: np.ndarray, names: list[str], folds: np.ndarray) -> Chain:
    """rows: distinct feature numbers; labels: a column of 0 and 1 for each name; folds: the fold of each row."""
    before, models = np.zeros((len(rows), 0)), []
    for k in range(len(names)):
        models.append(fit(rows, labels[:, k], before))
        if k + 1 < len(names):
            out = np.zeros(len(rows))
            for f in range(FOLDS):
                train, test = np.flatnonzero(folds != f), np.flatnonzero(folds == f)
                part = fit([rows[i] for i in train], labels[train, k], before[train])
                out[test] = [part.probability(rows[i], before[i]) for i in test]
            before = np.column_stack([before, out])
    return Chain(names, models)


def split(rows: list[np.ndarray], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features that speak for toxic, in two groups of which each occurs in the same toxic rows (spectral co-clustering).

    Both groups hold all of them if nothing tells two groups apart.
    """
    model = fit(rows, toxic)
    telling = model.chosen[np.lexsort((model.chosen, -model.weights))[:TELLING]]
    telling = np.sort(telling[np.isin(telling, model.chosen[model.weights > 0])])
    if not len(telling):
        return telling, telling
    held = np.array([np.isin(telling, r) for r, y in zip(rows, toxic, strict=True) if y], float).reshape(-1, len(telling))
    held = held[held.any(axis=1)]
    if not held.size:
        return telling, telling
    scaled = held / np.sqrt(np.outer(held.sum(axis=1), np.maximum(held.sum(axis=0), 1)))
    # The part that all features share is taken out first, since two groups without a common row are as strong as it is.
    common = np.sqrt(held.sum(axis=0)) / np.sqrt(held.sum())
    values, vectors = np.linalg.eigh(scaled.T @ scaled - np.outer(common, common))
    if len(values) < 2 or values[-1] < 1e-9:
        return telling, telling
    # Divided by their frequency; the first feature lies in the first group.
    second = vectors[:, -1] / np.sqrt(np.maximum(held.sum(axis=0), 1))
    first = second * (1 if second[0] >= 0 else -1) >= 0
    return (telling[first], telling[~first]) if not first.all() else (telling, telling)


def train(labelled: DataFrame, names: list[str]) -> Chain:
    """Fits a chain on the driver, on a bounded sample of labelled documents (see labelled).

    labelled: doc_id, text and a 0/1 column for each of names; rows with a null in any are left out.
    """
    fold = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(FOLDS)).cast("int")
    rows = labelled.select("doc_id", "text", fold.alias("fold"), F.array(*[F.col(n).cast("double") for n in names]).alias("y")).filter("not exists(y, v -> v is null)")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "fold": b.fold, "found": [np.unique(features(t)) for t in b.text], "y": b.y})

    found, table = gathered(rows.mapInPandas(run, "doc_id long, fold int, found array<int>, y array<double>"), ["doc_id"])
    y = np.array(table["y"].to_pylist(), float).reshape(len(found), len(names))
    return fit_chain(found, y, names, table["fold"].to_numpy())


#: Probability from which the last category counts.
THRESHOLD = 0.6


def _all(chain: Chain, texts: pd.Series) -> np.ndarray:
    none = [0.0] * len(chain.names)
    return np.array([chain.probabilities(t) if t and any(c.isalpha() for c in t) else none for t in texts]).reshape(len(texts), len(none))


def score(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text → doc_id, p_<name> for each category, and toxic_pred: the last category reaches the threshold.

    A null, empty or letterless text has no feature and is not toxic: all its probabilities are 0.
    """
    names = chain.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = _all(chain, b.text)
            yield pd.DataFrame({"doc_id": b.doc_id.astype("Int64")} | {f"p_{n}": p[:, k] for k, n in enumerate(names)} | {"toxic_pred": p[:, -1] >= threshold})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, " + ", ".join(f"p_{n} double" for n in names) + ", toxic_pred boolean")


def clean(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score does not call toxic, whole and without a shuffle."""

    @F.pandas_udf("boolean")
    def keep(text: pd.Series) -> pd.Series:
        return pd.Series(_all(chain, text)[:, -1] < threshold, dtype=bool)

    return docs.filter(keep("text"))


def labelled(docs: DataFrame, labels: DataFrame, at_most: int = SAMPLE) -> DataFrame:
    """doc_id, text, insult, contempt and toxic of about at_most labelled documents, drawn by a hash of doc_id.

    labels (doc_id, toxic) has one toxic column; a null says nothing, and 1 holds against 0 for the same doc_id. The
    narrower categories are those toxic documents that hold a feature of one of two groups, found by split in the drawn
    rows. They may overlap, and their names insult and contempt only tell them apart.
    The drawn labels are at_most ids and numbers, so they are broadcast, and no text of another document is moved.
    Of rows that repeat a doc_id, the one with the least text counts.
    """
    known = labels.select("doc_id", "toxic").dropna().groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    drawn = sampled(known, known.count(), at_most, 2)
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").filter("text is not null")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    rows = Scratch(docs.sparkSession, "toxicity").write(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "found": [np.unique(features(t)) for t in b.text], "toxic": b.toxic})

    found, table = gathered(rows.mapInPandas(run, "doc_id long, found array<int>, toxic int"), ["doc_id"])
    groups = split(found, table["toxic"].to_numpy())

    def has(group: np.ndarray) -> Column:
        @F.pandas_udf("int")
        def held(text: pd.Series) -> pd.Series:
            return pd.Series([int(np.isin(features(t), group).any()) for t in text], dtype="int32")

        return held("text")

    return rows.select("doc_id", "text", *[(F.col("toxic") * has(g)).alias(n) for n, g in zip(("insult", "contempt"), groups, strict=True)], "toxic")
