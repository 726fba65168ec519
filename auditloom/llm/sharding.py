"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows lie in blocks. How many rows each block sends to each shard is drawn first, from the multivariate hypergeometric
distribution that a uniform shuffle of all rows implies. Each block then permutes its rows and deals them out by these
counts, the shards receive them, and each shard permutes again. DataFrame functions only; the driver draws the matrix
from one count for each block.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.common import Scratch

#: Blocks that are permuted on their own, and parts of a shard that are.
BLOCKS, PARTS = 1024, 256


def hypergeometric(rng: np.random.Generator, good: int, total: int, draws: int) -> int:
    """Number of good ones among draws from total, by inversion around the mode; total may be of any size."""
    low, high = max(0, draws - (total - good)), min(good, draws)
    if low == high:
        return low
    p = good / total
    spread = int(20 * np.sqrt(draws * p * (1 - p) * (total - draws) / max(total - 1, 1))) + 20
    mode = min(max(int((draws + 1) * (good + 1) / (total + 2)), low), high)
    a, b = max(low, mode - spread), min(high, mode + spread)
    k = np.arange(a, b, dtype=np.float64)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(total - good - draws + k + 1)
    log_p = np.concatenate([[0.0], np.cumsum(steps)])
    weight = np.exp(log_p - log_p.max())
    return a + int(np.searchsorted(np.cumsum(weight), rng.random() * weight.sum()))


def communication_matrix(blocks: dict[int, int], shards: int, seed: int) -> list[tuple[int, int, int, int]]:
    """(block, shard, rows before in the block's order, rows) for each block with its number of rows.

    Shard sizes differ by one row at most; the larger ones come first.
    """
    rng, total = np.random.default_rng(seed), sum(blocks.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    out = []
    for block in sorted(blocks):
        left, whole, before = blocks[block], sum(room), 0
        for s in range(shards):
            take = hypergeometric(rng, room[s], whole, left) if left and whole else 0
            whole -= room[s]
            if take:
                out.append((block, s, before, take))
            room[s] -= take
            before += take
            left -= take
    return out


def key(*cols: Column | str) -> Column:
    """A 64-bit hash used as a random number."""
    return F.xxhash64(*cols)


def shard(docs: DataFrame, shards: int = 16, seed: int = 5) -> DataFrame:
    """A shard and a place in it for each row of docs (doc_id, text).

    Returns doc_id, size, text_crc32, shard and slot. size is the number of UTF-8 bytes plus 1 (null text: 1) and
    text_crc32 is unsigned (null: that of an empty text). Shard sizes differ by one row at most, and the slots of a
    shard run from 0 without gaps. Every assignment of rows to places is equally likely over the seeds, so that equal
    texts spread like any others; rows equal in doc_id and text are interchangeable. The same rows give the same
    result, whatever files and partitions they come in. A null doc_id is an id like any other.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    narrow = scratch.write(narrow.withColumn("block", F.pmod(key("doc_id", "text_crc32", F.lit(seed)), F.lit(BLOCKS)).cast("int")))
    counts = {r.block: r.n for r in narrow.groupBy("block").agg(F.count("*").alias("n")).collect()}  # BLOCKS numbers at most
    matrix = json.dumps([{"block": b, "shard": s, "before": before, "rows": n} for b, s, before, n in communication_matrix(counts, shards, seed)])
    cells = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(matrix), "array<struct<block int, shard int, before long, rows long>>")))

    tie = ["doc_id", "text_crc32", "size"]
    local = F.row_number().over(Window.partitionBy("block").orderBy(key("doc_id", "text_crc32", F.lit(seed + 1)), *tie)) - 1
    dealt = narrow.withColumn("at", local)
    # A block's order is cut where the matrix says: the cell with the largest "before" that is not over "at".
    cuts = cells.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("before", "shard"))).alias("cuts"))
    last = F.filter("cuts", lambda c: c["before"] <= F.col("at"))
    sent = dealt.join(F.broadcast(cuts), "block").select(*tie, F.element_at(last, -1)["shard"].alias("shard"))  # BLOCKS rows of shards cuts
    again = key("doc_id", "text_crc32", F.lit(seed + 2))
    sent = scratch.write(sent.withColumn("part", F.pmod(key(again), F.lit(PARTS)).cast("int")))

    parts = sent.groupBy("shard", "part").agg(F.count("*").alias("n"))
    offsets = parts.withColumn("offset", F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).select("shard", "part", "offset")
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy(again, *tie)) - 1
    return sent.withColumn("place", place).join(F.broadcast(offsets), ["shard", "part"]).select(*tie, "shard", (F.col("offset") + F.col("place")).alias("slot"))  # shards x PARTS rows


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 5) -> None:
    """Writes the whole rows of docs as Parquet, a folder for each shard, in the order of their slots within files.

    Columns of docs named shard or slot are replaced.
    """
    docs = docs.drop("shard", "slot")
    id_, crc = F.col("doc_id").cast("long").alias("i"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("c")
    own = docs.select(F.struct("*").alias("row"), id_, crc)  # the columns of docs cannot clash within a struct
    own = own.withColumn("k", F.row_number().over(Window.partitionBy("i", "c").orderBy("c")))
    placed = shard(docs, shards, seed).select(F.col("doc_id").alias("i2"), F.col("text_crc32").alias("c2"), "shard", "slot")
    placed = placed.withColumn("k2", F.row_number().over(Window.partitionBy("i2", "c2").orderBy("slot")))
    whole = own.join(placed, F.col("i").eqNullSafe(F.col("i2")) & (F.col("c") == F.col("c2")) & (F.col("k") == F.col("k2"))).select("row.*", "shard", "slot")
    whole.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
