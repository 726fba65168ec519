"""Hard negatives: for each anchor and positive the best-scoring rows of other labels just below the positive.

The rows lie in blocks as matrices. Each block of anchors meets each block of rows in a task: one matrix product gives all
scores, each anchor's scores are sorted with the ids as ties, positives are read from the top, and negatives from where a
binary search finds each positive's limit. The best of all blocks together are the best of all. Positives must be known
before negatives are searched, so the blocks meet twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.common import Scratch

#: Rows and anchors of a block, anchors that are scored at a time, and the most tasks that blocks meet in.
ROWS, ANCHORS, SLICE, TASKS = 2048, 1024, 128, 20_000
#: Components are multiplied by this and rounded down.
SCALE = 256
#: Positives of an anchor, negatives of a positive, least and greatest score of a negative in percent of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 5, 80, 100

_BLOCK = "block long, width int, ids binary, labels binary, vectors binary"


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label and embedding (doubles) of the rows that take part: nothing null, every component finite."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # NaN is above all numbers
    return rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long"), F.col("label").cast("long"), vector.alias("embedding"))


def packed(rows: DataFrame, size: int, scale: int = SCALE, more: str = "") -> DataFrame:
    """rows (vec_id, label, embedding, more) in blocks of size rows at most, components scaled and rounded down. Shorter vectors end in zeros."""
    names = [x.split()[0] for x in more.split(", ") if x]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            for at in range(0, len(b), size):
                p = b.iloc[at : at + size]
                matrix = np.zeros((len(p), max(map(len, p.embedding))))
                for i, v in enumerate(p.embedding):
                    matrix[i, : len(v)] = np.floor(scale * np.asarray(v, np.float64))
                row = [number, matrix.shape[1], p.vec_id.to_numpy(np.int64).tobytes(), p.label.to_numpy(np.int64).tobytes(), matrix.tobytes(), *(list(p[c]) for c in names)]
                yield pd.DataFrame({c: [v] for c, v in zip([x.split()[0] for x in _BLOCK.split(", ")] + names, row, strict=True)})
                number += 1

    return rows.select("vec_id", "label", "embedding", *names).mapInPandas(run, ", ".join([_BLOCK, more] if more else [_BLOCK]))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of two matrices of whole numbers, exactly. Fails where they might not fit in a long."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(width, 1)
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    if most < 2**63:
        return a.astype(np.int64) @ b.T.astype(np.int64)
    raise ValueError("scores may not fit in a long")


def _sorted(anchors: dict, rows: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(place of the anchor, ids, labels and scores of the rows) with scores from the highest on, ties by id."""
    for at in range(0, len(anchors["ids"]), SLICE):
        s = scores(anchors["vectors"][at : at + SLICE], rows["vectors"])
        order = np.lexsort((np.broadcast_to(rows["ids"], s.shape), -s))
        for i, o in enumerate(order):
            yield at + i, rows["ids"][o], rows["labels"][o], s[i][o]


def _unpacked(row, prefix: str) -> dict:
    get = lambda name: getattr(row, prefix + name)
    ids = np.frombuffer(get("ids"), np.int64)
    return {"ids": ids, "labels": np.frombuffer(get("labels"), np.int64), "vectors": np.frombuffer(get("vectors"), np.float64).reshape(len(ids), get("width"))}


def _meetings(anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """Each block of anchors beside each block of rows. Both sides are dealt by (lane of the anchors, lane of the rows).

    A block has one lane of its own and goes to all lanes of the other side, so that a pair of blocks meets once.
    """
    n_a, n_r = anchors.count(), rows.count()
    if not n_a or not n_r:
        return anchors.limit(0).select([F.col(c).alias(f"a_{c}") for c in anchors.columns]).join(rows.limit(0).select([F.col(c).alias(f"r_{c}") for c in rows.columns]), F.lit(False))
    lane = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tasks = min(n_a * n_r, TASKS)
    left = anchors.select([F.col(c).alias(f"a_{c}") for c in anchors.columns] + [lane(n_a).alias("ga"), all_of(n_r).alias("gr")]).repartition(tasks, "ga", "gr")
    right = rows.select([F.col(c).alias(f"r_{c}") for c in rows.columns] + [lane(n_r).alias("gr"), all_of(n_a).alias("ga")]).repartition(tasks, "ga", "gr")
    return left.join(right, ["ga", "gr"]).drop("ga", "gr")


def _best_positives(meetings: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                a, out = _unpacked(row, "a_"), []
                for i, ids, labels, s in _sorted(a, _unpacked(row, "r_")):
                    at = np.flatnonzero((labels == a["labels"][i]) & (ids != a["ids"][i]))[:k]
                    out.append((np.full(len(at), a["ids"][i]), ids[at], s[at]))
                yield pd.DataFrame(dict(zip(("anchor_id", "positive_id", "positive_score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    found = meetings.mapInPandas(run, "anchor_id long, positive_id long, positive_score long")
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    return found.withColumn("place", place).filter(F.col("place") <= k)


def _best_negatives(meetings: DataFrame, k: int, low: int, high: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                a, out = _unpacked(row, "a_"), []
                for i, ids, labels, s in _sorted(a, _unpacked(row, "r_")):
                    other = labels != a["labels"][i]
                    ids, s = ids[other], s[other]
                    for place, positive, score in row.a_positives[i]:
                        start = int(np.searchsorted(-s, -(high * score // 100)))
                        n = int(np.count_nonzero(100 * s[start : start + k] >= low * score))
                        out += [(int(a["ids"][i]), int(positive), int(place), int(score), int(x), int(y)) for x, y in zip(ids[start : start + n], s[start : start + n], strict=True)]
                if out:
                    yield pd.DataFrame(out, columns=["anchor_id", "positive_id", "place", "positive_score", "negative_id", "negative_score"])

    found = meetings.mapInPandas(run, "anchor_id long, positive_id long, place int, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def mine(rows: DataFrame, anchor: str = "vec_id % 100 = 0", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows (vec_id, label, embedding).

    anchor: condition on vec_id and label that tells the anchors. An anchor's positives are its best-scoring other rows of
    the same label; a positive's negatives the best-scoring rows of other labels with a score from low to high percent of
    the positive's. Scores are inner products of the components times scale, rounded down; ties go to the smaller vec_id.
    Rows with a null vec_id, label, vector or component or with one that isn't finite take no part. Vectors of different
    lengths are compared over what both have. Repeated rows count each; an anchor's vec_id that occurs several times is
    answered once, by its least label and vector, and is never its own positive. An anchor without a positive, or a
    positive without a negative in range, has no row.
    """
    scratch = Scratch(rows.sparkSession, "negatives")
    used = usable(rows)
    chosen = used.filter(anchor).groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v")).select("vec_id", "v.label", "v.embedding")
    chosen = scratch.write(chosen)
    parts = -(-chosen.count() // ANCHORS) or 1
    blocks = scratch.write(packed(used, ROWS, scale))
    asked = scratch.write(packed(chosen.repartition(parts, "vec_id"), ANCHORS, scale))
    best = _best_positives(_meetings(asked, blocks), positives)
    lists = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_list(F.array(F.col("place").cast("long"), "positive_id", "positive_score"))).alias("positives"))  # as many as asked for
    limits = scratch.write(chosen.join(lists, "vec_id"))
    scratch.drop(asked, chosen)
    asked = scratch.write(packed(limits.repartition(parts, "vec_id"), ANCHORS, scale, "positives array<array<array<long>>>"))
    return _best_negatives(_meetings(asked, blocks), negatives, low, high).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
