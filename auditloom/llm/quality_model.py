"""Text quality from weak labels.

Heuristic labellers vote on each document: good, bad or no vote. Expectation-maximisation over the counts of vote
patterns of all documents estimates how accurate each labeller is and, for each pattern, the probability that a
document is bad. These posteriors are the targets of a hashed linear scorer over word shapes, which then scores
every document by features that the labellers do not look at directly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import Scratch, Words, mix64
from auditloom.llm.linear import SAMPLE, Linear, fit, gathered, hashed, sampled

# Limits of the labellers; a share up to the first is good, from the second on bad, between them no vote.
LIMITS = {
    "symbols": (0.05, 0.30),  # characters of #$%&*|<>{}[]\\^~=_ for each word
    "decorated": (0.05, 0.30),  # words that hold such a character beside letters or digits
    "capitals": (0.15, 0.50),  # capital letters among all ASCII letters
    "repeats": (0.05, 0.25),  # words equal to the word before
    "separators": (0.02, 0.20),  # words without a letter or digit
    "exclaims": (0.05, 0.30),  # words that end in two exclamation marks
    "fewness": (0.75, 0.90),  # 1 - distinct words / words, the highest of all SPAN words in a row, for 40 words or more
}
NAMES = tuple(LIMITS)
#: Words in a row among which distinct ones are counted, so that the share does not grow with the length of a text.
SPAN = 400

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = ord("a")
_CLASS[128:] = ord("a")
_CLASS[65:91] = ord("A")
_CLASS[48:58] = ord("0")
_CLASS[[9, 10, 11, 12, 13]] = 32
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*|<>{}[]\\^~=_")] = True


def fewest(words: np.ndarray, span: int = SPAN) -> int:
    """The least number of distinct values in any span of consecutive ones (in all, if there are no more)."""
    n = len(words)
    if n <= span:
        return len(np.unique(words))
    order = np.argsort(words, kind="stable")
    before = np.full(n, -1)
    again = words[order[1:]] == words[order[:-1]]
    before[order[1:][again]] = order[:-1][again]
    # A word is the first of its kind in the spans that start after its last occurrence and reach it.
    at = np.arange(n)
    first, last = np.maximum(before + 1, at - span + 1), np.minimum(at, n - span)
    seen = first <= last
    change = np.bincount(first[seen], minlength=n + 1) - np.bincount(last[seen] + 1, minlength=n + 1)
    return int(np.cumsum(change)[: n - span + 1].min())


def examine(text: str | None) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of words, the labellers' shares (nan: not applicable) and the feature numbers of a text."""
    raw = (text or "").encode("utf-8", "replace")
    words = Words(raw)
    n = len(words)
    if not n:
        return 0, np.full(len(NAMES), np.nan), np.zeros(0, np.int32)
    data = np.frombuffer(raw, np.uint8)
    own = words.hashes()
    kinds = _CLASS[data]
    letters, capitals = np.count_nonzero((kinds == 97) | (kinds == 65)), np.count_nonzero(kinds == 65)
    solid = np.concatenate([[0], np.cumsum((kinds == 97) | (kinds == 65) | (kinds == 48))])
    signs = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    empty = np.count_nonzero(solid[words.ends] == solid[words.starts])
    bang = np.count_nonzero((data[words.ends - 1] == 33) & (data[np.maximum(words.ends - 2, 0)] == 33))
    same = np.concatenate([[False], own[1:] == own[:-1]])
    shares = np.array([
        np.count_nonzero(_SYMBOL[data]) / n,
        np.count_nonzero((solid[words.ends] > solid[words.starts]) & (signs[words.ends] > signs[words.starts])) / n,
        capitals / letters if letters >= 20 else np.nan,
        same.mean(),
        empty / n,
        bang / n,
        1 - fewest(own) / min(n, SPAN) if n >= 40 else np.nan,
    ])
    # Word shapes: each run of one kind of character counts as one; how large a share of the words has the shape.
    starts_word = np.zeros(len(data) + 1, bool)
    starts_word[words.starts] = True
    keep = np.concatenate([[True], kinds[1:] != kinds[:-1]]) | starts_word[:-1]
    shapes, counts = np.unique(np.where(same, np.uint64(1), Words(kinds[keep].tobytes()).hashes()), return_counts=True)
    level = np.digitize(counts / n, (0.02, 0.1, 0.3, 0.6)).astype(np.uint64)
    return n, shares, np.unique(hashed(np.concatenate([mix64(shapes * np.uint64(8) + np.uint64(k))[level >= k] for k in range(5)])))


def votes(shares: np.ndarray) -> str:
    """A letter for each labeller: g, b or -."""
    return "".join("-" if np.isnan(x) else "g" if x <= low else "b" if x >= high else "-" for x, (low, high) in zip(shares, LIMITS.values(), strict=True))


def label_model(patterns: dict[str, int], rounds: int = 100) -> tuple[dict[str, float], np.ndarray, float]:
    """Expectation-maximisation over vote patterns and their counts.

    Returns the probability of bad for each pattern; for each class (good, bad) and labeller the probability that
    its vote is good or bad; and the share of bad documents. Votes are taken as independent given the class, and
    a missing vote says nothing. It starts from the patterns that hold a vote for bad; 1 is added to each count.
    """
    keys = sorted(patterns)
    if not keys:
        return {}, np.full((2, len(NAMES), 2), 0.5), 0.0
    count = np.array([patterns[k] for k in keys], float)
    code = np.array([["gb-".index(c) for c in k] for k in keys])
    bad = np.where((code == 1).any(axis=1), 0.9, 0.05)
    for _ in range(rounds):
        table = np.ones((2, code.shape[1], 3))
        for y, share in ((0, 1 - bad), (1, bad)):
            for j in range(code.shape[1]):
                table[y, j] += np.bincount(code[:, j], share * count, 3)
        table[:, :, :2] /= table[:, :, :2].sum(axis=2, keepdims=True)
        table[:, :, 2] = 1
        prior = (1 + bad @ count) / (2 + count.sum())
        fit_ = [np.log(p) + np.log(table[y, np.arange(code.shape[1]), code]).sum(axis=1) for y, p in ((0, 1 - prior), (1, prior))]
        bad = 1 / (1 + np.exp(np.clip(fit_[0] - fit_[1], -50, 50)))
    return dict(zip(keys, bad.tolist(), strict=True)), table[:, :, :2], float(prior)


class Scorer:
    """What was learned: the probability of bad for each vote pattern, and the linear scorer."""

    def __init__(self, weak: dict[str, float], model: Linear):
        self.weak, self.model = weak, model

    def p_bad(self, n: int, found: np.ndarray) -> float:
        return self.model.probability(found) if n else 1.0


def examined(text: str) -> Column:
    """What examine finds in the texts of a column, with the votes, as a struct."""

    @F.pandas_udf("n_words long, votes string, found array<int>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [examine(t) for t in texts]
        return pd.DataFrame({"n_words": [r[0] for r in rows], "votes": [votes(r[1]) for r in rows], "found": [r[2] for r in rows]})

    return run(text)


def learn(seen: DataFrame, at_most: int = SAMPLE) -> Scorer:
    """Learns from what was seen of each row (doc_id, n_words, votes, found).

    The label model's counts cover all rows. The scorer is fitted on about at_most rows, drawn by a hash of doc_id.
    """
    # At most 3 ** len(NAMES) patterns.
    patterns = {r.votes: r.n for r in seen.filter("n_words > 0").groupBy("votes").agg(F.count("*").alias("n")).collect()}
    weak, _, _ = label_model(patterns)
    sample = sampled(seen.filter("n_words > 0"), sum(patterns.values()), at_most, 7).select("doc_id", "votes", "found")
    found, table = gathered(sample, ["doc_id", "votes"])
    return Scorer(weak, fit(found, np.array([weak[v] for v in table["votes"].to_pylist()])))


def quality(docs: DataFrame, at_most: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """doc_id, text → doc_id, n_words, votes, p_bad_weak, p_bad and kept, a row for each row of docs.

    votes has a letter for each labeller, in the order of NAMES; p_bad_weak is the label model's probability and
    p_bad that of the linear scorer. kept: the text has a word and p_bad is under the threshold. A null, empty or
    wordless text has p_bad 1. An empty table gives an empty result.
    """
    own = docs.select(F.col("doc_id").cast("long"), examined("text").alias("seen"))
    seen = Scratch(docs.sparkSession, "quality").write(own).select("doc_id", "seen.*")
    scorer = learn(seen, at_most)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = np.array([scorer.p_bad(n, np.asarray(x)) for n, x in zip(b.n_words, b.found, strict=True)], float)
            weak = [scorer.weak[v] if n else 1.0 for n, v in zip(b.n_words, b.votes, strict=True)]
            yield pd.DataFrame({"doc_id": b.doc_id.astype("Int64"), "n_words": b.n_words, "votes": b.votes, "p_bad_weak": weak, "p_bad": p, "kept": p < threshold})

    return seen.mapInPandas(scored, "doc_id long, n_words long, votes string, p_bad_weak double, p_bad double, kept boolean")


def good(docs: DataFrame, at_most: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that quality keeps, whole. Each text is looked at once: its features are written beside the row."""
    seen = "_".join(["seen", *docs.columns])  # a name that no column has
    whole = Scratch(docs.sparkSession, "quality").write(docs.withColumn(seen, examined("text")))
    scorer = learn(whole.select(F.col("doc_id").cast("long"), f"{seen}.*"), at_most)

    @F.pandas_udf("boolean")
    def keep(n_words: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([scorer.p_bad(n, np.asarray(x)) < threshold for n, x in zip(n_words, found, strict=True)], dtype=bool)

    return whole.filter(keep(f"{seen}.n_words", f"{seen}.found")).select(*docs.columns)
