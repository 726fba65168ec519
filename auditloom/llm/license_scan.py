"""License scans: winnowed fingerprints pick candidates, banded alignment reports what matches.

The templates' word k-grams are hashed and winnowed into an inverted index, with k and window so small for each template
that no match of the least coverage goes without a seed. A text's k-grams that hit the index give a template and a diagonal
(place in the text minus place in the template). Around each diagonal whose band holds enough of the template's words it is
aligned with the text's words within the band, and the share of its words that match is reported with the span of the text.
The words that tell a license from its like, its name and version, must all match, side by side.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import Words, rolled
from auditloom.llm.license_texts import TELLING, TEXTS

#: License notices, short license texts and lines that refer to a license.
TEMPLATES = TEXTS
#: Words by which an alignment may leave its diagonal, least coverage, and the most words of a k-gram.
BAND, LEAST, GRAM = 4, 0.8, 3

_WORDY = np.zeros(256, bool)
_WORDY[48:58] = _WORDY[97:123] = _WORDY[128:] = True


def tokens(text: str | None) -> tuple[Words, np.ndarray]:
    """Words are runs of letters and digits of the lower-cased text."""
    words = Words((text or "").lower().encode("utf-8", "replace"), _WORDY)
    return words, words.hashes()


def winnow(hashes: np.ndarray, window: int) -> list[tuple[int, int]]:
    """(hash, place) of the least hash of each window, the rightmost of equal ones, each place once."""
    picked: dict[int, int] = {}
    for i in range(max(1, len(hashes) - window + 1)):
        part = hashes[i : i + window]
        if len(part):
            at = i + len(part) - 1 - int(part[::-1].argmin())
            picked[at] = int(hashes[at])
    return [(h, at) for at, h in picked.items()]


def seed_size(length: int, need: int, band: int) -> tuple[int, int]:
    """Words of a k-gram and k-grams of a window, such that any alignment of need of length words leaves a seed.

    The words of a template that don't match and words put into the text break an alignment into runs. Words can be
    put in at most at so many places as the band has offsets, and once more for each template word that is left out. A
    run of gram + window - 1 words holds a k-gram that winnowing keeps, and one of the runs has at least the mean length.
    """
    missed = length - need
    run = -(-need // (1 + min(max(need, 1) - 1, missed + 2 * band + missed)))
    gram = max(1, min(GRAM, run))
    return gram, run - gram + 1


class Index:
    """Templates by name, with an inverted index of their winnowed k-grams for each size of k-gram in use."""

    def __init__(self, templates: dict[str, str], band: int = BAND, least: float = LEAST, telling: dict[str, tuple[str, ...]] | None = None):
        self.names, self.band = sorted(templates), band
        self.words = [tokens(templates[n])[1] for n in self.names]
        self.runs = [self._runs(w, (telling or {}).get(n, ())) for n, w in zip(self.names, self.words, strict=True)]
        self.need = np.array([math.ceil(least * len(w)) for w in self.words])
        self.vocabulary = np.unique(np.concatenate(self.words))
        self.counts = np.stack([np.bincount(np.searchsorted(self.vocabulary, w), minlength=len(self.vocabulary)) for w in self.words])
        self.places: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for t, words in enumerate(self.words):
            gram, window = seed_size(len(words), int(self.need[t]), band)
            for h, at in winnow(rolled(words, gram), window):
                self.places[gram][h].append((t, at))
        self.places = {g: dict(p) for g, p in self.places.items()}

    @staticmethod
    def _runs(words: np.ndarray, phrases: tuple[str, ...]) -> np.ndarray:
        """For each word of a template the number of the phrase that it belongs to, 0 for none. The first place of a phrase counts."""
        out = np.zeros(len(words), int)
        for number, phrase in enumerate(phrases, 1):
            wanted = tokens(phrase)[1]
            at = next(i for i in range(len(words) - len(wanted) + 1) if (words[i : i + len(wanted)] == wanted).all())
            out[at : at + len(wanted)] = number
        return out

    def diagonals(self, hashes: np.ndarray) -> list[tuple[int, int]]:
        """(template, diagonal) of all bands around a seed in which enough of the template's words occur to reach LEAST."""
        if not len(self.vocabulary):
            return []
        where = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = np.flatnonzero(self.vocabulary[where] == hashes)
        present = np.bincount(where[known], minlength=len(self.vocabulary)) > 0
        likely = set(np.flatnonzero(self.counts @ present >= self.need).tolist())
        if not likely:
            return []
        seeds = defaultdict(set)
        for gram, places in self.places.items():
            if len(hashes) < gram:
                continue
            grams = rolled(hashes, gram)
            for i in known[known < len(grams)].tolist():
                for t, place in places.get(int(grams[i]), ()):
                    if t in likely:
                        seeds[t].add(i - place)
        out = []
        for t in sorted(seeds):
            enough = self._enough(t, hashes, known)
            out += [(t, d) for d in sorted({d + k for d in seeds[t] for k in range(-self.band, self.band + 1)}) if d in enough]
        return out

    def _enough(self, t: int, hashes: np.ndarray, known: np.ndarray) -> set[int]:
        """Diagonals within whose band the text has enough of a template's words."""
        words, own = self.words[t], known[np.isin(hashes[known], self.words[t])]
        order = np.argsort(words, kind="stable")
        low, high = (np.searchsorted(words[order], hashes[own], side) for side in ("left", "right"))
        n = high - low
        place = order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
        diagonal = np.repeat(own, n) - place
        by = np.lexsort((diagonal, place))
        place, diagonal = place[by], diagonal[by]
        start, end = diagonal - self.band, diagonal + self.band + 1
        # Each word of the template counts once on a diagonal, however often its band has it.
        start[1:] = np.where(place[1:] == place[:-1], np.maximum(start[1:], end[:-1]), start[1:])
        base = int(start.min())
        size = int(end.max()) - base + 1
        inside = np.cumsum(np.bincount(start - base, minlength=size) - np.bincount(end - base, minlength=size))
        return set((np.flatnonzero(inside >= self.need[t]) + base).tolist())


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int, runs: np.ndarray | None = None) -> tuple[int, int, int]:
    """Longest common subsequence within the band around a diagonal: words matched, first and last place in text.

    runs: for each word of the template the number of the run it belongs to, or 0. Words of runs must match, those of one run
    side by side; (0, -1, -1) where no alignment has them all.
    """
    width, nothing, never = 2 * band + 1, (0, -1, -1), (-1, -1, -1)
    best: list[tuple[int, int, int]] = [nothing] * width  # by offset: matched, -first place, last place
    outside, hits = nothing, best
    for i, w in enumerate(template):
        run = runs[i] if runs is not None else 0
        before = hits if run and i and runs[i - 1] == run else best
        if run:
            outside = never
        row: list[tuple[int, int, int]] = []
        hits = []
        for k in range(width):
            j = i + diagonal + k - band
            options = [row[k - 1] if k else outside, never]
            if not run:
                options.append(best[k + 1] if k + 1 < width else outside)
            hits.append(never)
            if 0 <= j < len(text) and text[j] == w and before[k][0] >= 0:
                n, first, _ = before[k]
                hits[k] = (n + 1, first if n else -j, j)
                options.append(hits[k])
            row.append(max(options, key=lambda o: (o[0], o[1])))
        best = row
    n, first, last = max(best, key=lambda o: (o[0], o[1], -o[2]))
    return (n, -first, last) if n >= 0 else nothing


def matches(text: str | None, index: Index) -> list[tuple[str, float, int, int, int, int]]:
    """(template, coverage, first and last word, first and last character + 1) of each place where a template matches.

    Where places of one template overlap, the one with the highest coverage is kept, of equal ones the shortest. A place is
    left out if an overlapping place of another template is as good in coverage and words matched and better in
    one of them: a notice of one license holds most words of those of its variants.
    """
    words, hashes = tokens(text)
    found = set()
    for t, d in index.diagonals(hashes):
        n, first, last = align(index.words[t], hashes, d, index.band, index.runs[t])
        if n >= index.need[t]:
            found.add((-n / len(index.words[t]), first, last, t))
    out: list[tuple] = []
    for cover, first, last, t in sorted(found, key=lambda o: (o[0], o[2] - o[1], *o)):
        if not any(o[3] == t and o[1] <= last and first <= o[2] for o in out):
            out.append((cover, first, last, t))
    worth = lambda o: (-o[0], round(-o[0] * len(index.words[o[3]])))
    beats = lambda p, o: worth(p) != worth(o) and all(x >= y for x, y in zip(worth(p), worth(o), strict=True))
    out = [o for o in out if not any(p[1] <= o[2] and o[1] <= p[2] and beats(p, o) for p in out)]
    raw = (text or "").lower().encode("utf-8", "replace")
    char = lambda b: len(raw[:b].decode("utf-8", "replace"))
    return sorted((index.names[t], -c, f, e, char(words.starts[f]), char(words.ends[e])) for c, f, e, t in out)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, band: int = BAND, least: float = LEAST, telling: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Matches of license templates in docs (doc_id, text), a row for each.

    Returns doc_id, license, coverage (share of the template's words that match in order), first_word, last_word
    (counted from 0), first_char and end_char in the lower-cased text. A document may have several; one that matches
    nothing, a null or an empty text has no row. Repeated rows are each reported. The templates go to every task:
    they are given in the call and are few. telling: by template, runs of its words that must match side by side; those of
    the own templates where none are given.
    """
    index = Index(templates or TEMPLATES, band, least, TELLING if templates is None and telling is None else telling)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(None if pd.isna(i) else int(i), *m) for i, t in zip(b.doc_id, b.text, strict=True) for m in matches(t, index)]
            yield pd.DataFrame(rows, columns=["doc_id", "license", "coverage", "first_word", "last_word", "first_char", "end_char"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, license string, coverage double, first_word long, last_word long, first_char long, end_char long")
