"""Logistic models over hashed features, fitted on a bounded sample of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hashed features lie in range(SPACE).
SPACE = 1 << 20
#: Rows that a model is fitted on, at most about; a share of the rows is drawn by a hash of their id.
SAMPLE = 8_000
#: Features that a model keeps, at most: those with the highest chi-square statistics.
CHOSEN = 1_500


def hashed(values: np.ndarray) -> np.ndarray:
    """64-bit hashes to feature numbers."""
    return (values >> np.uint64(44)).astype(np.int32)


def sampled(df: DataFrame, rows: int, at_most: int, seed: int) -> DataFrame:
    """About at_most of the rows of df (all, if there are no more), drawn by a hash of doc_id: the same ones on each run."""
    share = min(1.0, at_most / max(rows, 1))
    return df.filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < round(share * 1_000_000))


def gathered(df: DataFrame, by: list[str]) -> tuple[list[np.ndarray], pa.Table]:
    """The rows of a bounded sample in the order of some columns: their feature numbers (column found), and all columns."""
    table = df.toArrow().sort_by([(c, "ascending") for c in by]).combine_chunks()
    if not len(table):
        return [], table
    found = table["found"].combine_chunks()
    values, at = found.values.to_numpy(), found.offsets.to_numpy()
    return [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], table


class Linear:
    """Weights of the features that passed selection, of dense extra columns, and an intercept."""

    def __init__(self, chosen: np.ndarray, weights: np.ndarray, extra: np.ndarray, bias: float):
        self.chosen, self.weights, self.extra, self.bias = chosen, weights, extra, bias
        self._table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_table": None}

    def row(self, features: np.ndarray) -> np.ndarray:
        """The distinct chosen features of a row, as positions among the weights."""
        if self._table is None:
            self._table = np.full(SPACE, -1, np.int32)
            self._table[self.chosen] = np.arange(len(self.chosen))
        at = self._table[features]
        return np.unique(at[at >= 0])

    def probability(self, features: np.ndarray, extra: list[float] | tuple = ()) -> float:
        z = self.bias + float(self.weights[self.row(features)].sum()) + float(np.dot(self.extra, extra) if len(self.extra) else 0)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[np.ndarray], y: np.ndarray, extra: np.ndarray | None = None, least_chi: float = 25.0, rounds: int = 150) -> Linear:
    """Class-balanced logistic regression on distinct feature numbers of each row, with targets y between 0 and 1.

    Features are kept that occur in 5 rows or more and whose chi-square statistic against the target reaches
    least_chi, CHOSEN at most. Full-batch gradient steps with per-weight scaling; the same rows give the same model.
    """
    n, y = len(rows), np.asarray(y, float)
    extra = np.zeros((n, 0)) if extra is None else np.asarray(extra, float)

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Feature numbers and their rows, for a few rows at a time."""
        for i in range(0, n, 256):
            part = rows[i : i + 256]
            yield np.concatenate(part), np.repeat(np.arange(i, i + len(part)), [len(r) for r in part])

    yes, no = np.zeros(SPACE), np.zeros(SPACE)
    for flat, row in blocks():
        yes += np.bincount(flat, y[row], SPACE)
        no += np.bincount(flat, 1 - y[row], SPACE)
    ny, nn = y.sum(), n - y.sum()
    chi = (yes * (nn - no) - no * (ny - yes)) ** 2 * n / np.maximum((yes + no) * (n - yes - no) * ny * nn, 1e-9)
    chosen = np.flatnonzero((chi >= least_chi) & (yes + no >= 5))
    chosen = np.sort(chosen[np.lexsort((chosen, -chi[chosen]))[:CHOSEN]])
    place = np.full(SPACE, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    used = [(row[keep], place[flat[keep]]) for flat, row in blocks() for keep in [place[flat] >= 0]]
    row, col = (np.concatenate([x[k] for x in used] or [np.zeros(0, int)]) for k in (0, 1))
    weight = np.where(y >= 0.5, 0.5 / max(ny, 1e-9), 0.5 / max(nn, 1e-9))
    w, v, b = np.zeros(len(chosen)), np.zeros(extra.shape[1]), 0.0
    gw, gv, gb = np.full(len(w), 1e-3), np.full(len(v), 1e-3), 1e-3
    if 0 < ny < n:
        for _ in range(rounds):
            z = np.bincount(row, w[col], n) + extra @ v + b
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
            sw, sv, sb = np.bincount(col, d[row], len(w)) + 1e-4 * w, extra.T @ d + 1e-4 * v, d.sum()
            gw, gv, gb = gw + sw**2, gv + sv**2, gb + sb**2
            w, v, b = w - 0.5 * sw / np.sqrt(gw), v - 0.5 * sv / np.sqrt(gv), b - 0.5 * sb / np.sqrt(gb)
    else:
        b = 10.0 if n and ny else -10.0
    return Linear(chosen, w, v, float(b))
