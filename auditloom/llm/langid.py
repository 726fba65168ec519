"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point. The vector of a letter n-gram binds (multiplies)
the letters' vectors, each permuted (rotated) by its place. A text bundles (adds) the vectors of its n-grams, a language's
prototype bundles those of its training texts, and a text gets the language whose prototype has the highest cosine.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Length of the vectors, letters of an n-gram, and n-gram vectors that a worker remembers.
WIDTH, GRAM, REMEMBERED = 1024, 3, 16_384
#: Slots over which the partial prototypes of a language are dealt before they are added.
SLOTS = 32

_basic = np.array([chr(i).isalpha() for i in range(0x3000)])


def letter_codes(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text; each run of other characters counts as one 0, also before and after."""
    if not text:
        return np.zeros(0, np.int64)
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    known = code < len(_basic)
    letter = np.zeros(len(code), bool)
    letter[known] = _basic[code[known]]
    if not known.all():
        rest, back = np.unique(code[~known], return_inverse=True)
        letter[~known] = np.array([chr(c).isalpha() for c in rest])[back]
    code = np.concatenate([[0], np.where(letter, code, 0), [0]])
    return code[np.concatenate([[True], (code[1:] != 0) | (code[:-1] != 0)])]


def grams(codes: np.ndarray) -> np.ndarray:
    """Each n-gram as one number: the code points, 21 bits each."""
    n = len(codes) - GRAM + 1
    if n <= 0 or not codes.any():
        return np.zeros(0, np.int64)
    out = np.zeros(n, np.int64)
    for i in range(GRAM):
        out = (out << 21) | codes[i : i + n]
    return out


class Vectors:
    """Vectors of n-grams, remembered for reuse; they follow from the code points alone."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.letters: dict[int, np.ndarray] = {}
        self.keys, self.places = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.rows = np.empty((REMEMBERED, WIDTH), np.float32)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            self.letters[code] = np.random.default_rng(code + 1).integers(0, 2, WIDTH).astype(np.int8) * 2 - 1
        return self.letters[code]

    def of(self, distinct: np.ndarray) -> np.ndarray:
        """A row for each of the sorted distinct n-grams, REMEMBERED at most."""
        at = np.searchsorted(self.keys, distinct)
        new = distinct[np.append(self.keys, -1)[at] != distinct]
        if len(new):
            if len(self.keys) + len(new) > REMEMBERED:
                self.clear()
                new = distinct
            made = np.ones((len(new), WIDTH), np.int8)
            for i in range(GRAM):
                codes, back = np.unique((new >> (21 * (GRAM - 1 - i))) & (2**21 - 1), return_inverse=True)
                made *= np.stack([np.roll(self.letter(int(c)), GRAM - 1 - i) for c in codes])[back]
            used = len(self.keys)
            self.rows[used : used + len(new)] = made
            keys, places = np.concatenate([self.keys, new]), np.concatenate([self.places, np.arange(used, used + len(new))])
            order = np.argsort(keys)
            self.keys, self.places = keys[order], places[order]
            at = np.searchsorted(self.keys, distinct)
        return self.rows[self.places[at]]

    def bundles(self, found: list[np.ndarray]) -> np.ndarray:
        """A row for each text: the sum of the vectors of its n-grams. Many distinct ones are added in parts."""
        sizes = [len(x) for x in found]
        out = np.zeros((len(found), WIDTH))
        if sum(sizes):
            distinct, number = np.unique(np.concatenate(found), return_inverse=True)
            counts = np.bincount(np.repeat(np.arange(len(found)), sizes) * len(distinct) + number, minlength=len(found) * len(distinct))
            counts = counts.reshape(len(found), len(distinct)).astype(np.float32)
            for i in range(0, len(distinct), REMEMBERED // 4):
                out += counts[:, i : i + REMEMBERED // 4] @ self.of(distinct[i : i + REMEMBERED // 4])
        return out


def in_blocks(texts: Iterable[str | None], texts_at_most: int = 64, grams_at_most: int = 200_000) -> Iterator[list[np.ndarray]]:
    """The n-grams of texts, some texts at a time; a block ends when it has either number."""
    block: list[np.ndarray] = []
    size = 0
    for t in texts:
        block.append(grams(letter_codes(t)))
        size += len(block[-1])
        if len(block) >= texts_at_most or size >= grams_at_most:
            yield block
            block, size = [], 0
    if block:
        yield block


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether a document is held out: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def prototypes(docs: DataFrame) -> dict[str, np.ndarray]:
    """Language → prototype, from docs (text, lang); rows with a null in either say nothing.

    Partitions send one partial sum a language. These are added in two steps, dealt out over slots first. What comes
    to the driver is one vector for each language.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors, sums = Vectors(), {}
        for b in batches:
            for lang, texts in b.groupby("lang").text:
                for block in in_blocks(texts, 100_000, 2_000_000):
                    sums[lang] = sums.get(lang, 0) + vectors.bundles([np.concatenate(block)])[0]
        slot = (TaskContext.get().partitionId() if TaskContext.get() else 0) % SLOTS
        if sums:
            yield pd.DataFrame({"lang": list(sums), "slot": slot, "v": [v.tolist() for v in sums.values()]})

    def added(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [group.lang.iloc[0]], "slot": [group.slot.iloc[0]], "v": [np.sum(np.stack(group.v.to_list()), axis=0).tolist()]})

    kind = "lang string, slot int, v array<double>"
    parts = docs.select("text", F.col("lang").cast("string")).dropna().mapInPandas(partial, kind)
    total = parts.groupBy("lang", "slot").applyInPandas(added, kind).withColumn("slot", F.lit(0)).groupBy("lang").applyInPandas(added, kind)
    return {r.lang: np.array(r.v) for r in total.collect()}


def identify(docs: DataFrame, learned: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, text → doc_id, lang_pred, score, a row for each row of docs.

    score is the cosine with the prototype, between 0 and 1 (0 where negative). Ties go to the language that comes
    first in code point order. A text that is null or has no letter, or any text if nothing was learned, gets
    ``und`` and score 0. Languages need a vector each on every worker; their number is taken to be small.
    """
    names = sorted(learned)
    table = np.stack([learned[n] / max(np.linalg.norm(learned[n]), 1e-9) for n in names]) if names else np.zeros((0, WIDTH))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors = Vectors()
        for b in batches:
            lang, score = [], []
            for block in in_blocks(b.text):
                v = vectors.bundles(block)
                near = v @ table.T / np.maximum(np.linalg.norm(v, axis=1), 1e-9)[:, None]
                for found, x in zip(block, near, strict=True):
                    known = len(found) and names
                    lang.append(names[int(x.argmax())] if known else "und")
                    score.append(float(np.clip(x.max(), 0.0, 1.0)) if known else 0.0)
            yield pd.DataFrame({"doc_id": b.doc_id.astype("Int64"), "lang_pred": lang, "score": score})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, lang_pred string, score double")
