"""Near-duplicate documents by SetSketch registers.

A document's set of word shingles is summarised by registers that hold an exponentially spaced, truncated minimum
(register i is floor(1 - log_b x_i), where x_i is the least exponential variate of the set). Registers of a union
are the register-wise maxima, and two registers agree with a probability close to the Jaccard similarity, so short
runs of registers (bands) put similar documents into common buckets. Candidates are estimated from both sketches
together by maximum likelihood, and those that may reach the threshold are verified on the full shingle sets.

The scale is fine enough that the registers of unrelated texts hardly ever agree: a band is shared by chance with a
probability of about 3e-12, so that buckets hold similar texts only, however many texts there are.

No bucket emits all of its pairs. Every member meets the bucket's smallest id; links found so merge into components;
only buckets that then still hold several components are compared further, in blocks of bounded size, where pairs
between different components are compared and only those that merge two are returned, to be confirmed on full sets.
A large group of near copies therefore costs about one comparison for each member and band, while no link that a band
proposes is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import WORD, Scratch, Words, mix64, released, rolled

#: Registers, rows of a band, base of the register scale and its rate.
BANDS, ROWS, BASE, RATE = 32, 5, 1.02, 20.0
#: Registers are truncated at this value; five of them fit in 64 bits.
TOP, BITS = 2047, 11
#: Members of a block of a bucket, of which two meet in one task; shingles of a text that are compared there.
BLOCK, SET = 1024, 2048

_rng = np.random.default_rng(77)
_A = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a text whose letters A-Z count as a-z."""
    return np.unique(rolled(Words((text or b"").lower()).hashes(), k))


def registers(shingles: np.ndarray) -> np.ndarray:
    """The SetSketch registers of a non-empty set of 64-bit hashes."""
    low, high = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_A), np.uint32(2**32 - 1))
    for i in range(0, len(low), 1024):
        x = low[i : i + 1024, None] * _A
        x += high[i : i + 1024, None] * _B
        np.minimum(least, x.min(axis=0), out=least)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype("<u2")


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches, given the sizes of both sets.

    The likelihood is that of the numbers of registers that are greater, less and equal. It is taken on a grid of
    101 values between 0 and the largest similarity that the sizes allow.
    """
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u = na / (na + nb)
    v = 1 - u
    j = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)[:, None]

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = p(u[:, None] - v[:, None] * j), p(v[:, None] - u[:, None] * j)
    fit = more[:, None] * np.log(up) + less[:, None] * np.log(down)
    fit += same[:, None] * np.log(np.clip(1 - up - down, 1e-12, 1))
    return j[np.arange(len(j)), fit.argmax(axis=1)]


def may_reach(threshold: float) -> float:
    """The estimate below which a pair is not verified: 4.5 standard errors under the threshold."""
    return threshold - 4.5 * float(np.sqrt(threshold * (1 - threshold) / len(_A)))


def sketches(docs: DataFrame, shingle_words: int) -> DataFrame:
    """One row per row of docs (doc_id, text): a hash of the text, size of the shingle set, its 128-bit digest and its registers.

    The digest is a sum and an exclusive or over the set, so that it doesn't depend on the words' order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sums, xors, sigs = [], [], [], []
            for text in batch.column(2).cast(pa.binary()):
                s = shingle_set(text.as_py(), shingle_words)
                sizes.append(len(s))
                sums.append(int(mix64(s).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0)
                xors.append(int(np.bitwise_xor.reduce(s).astype(np.int64)) if len(s) else 0)
                sigs.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(xors, pa.int64()), pa.array(sigs, pa.binary())],
                names=["doc_id", "text_hash", "n_shingles", "d1", "d2", "sig"],
            )

    return identified(docs).mapInArrow(released(run), "doc_id long, text_hash long, n_shingles long, d1 long, d2 long, sig binary")


def identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")


def with_nodes(rows: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """Adds node, which stands for the text of a row: its doc_id or, where different texts share that, a hash of both."""
    if repeated is None:
        return rows.withColumn("node", F.col("doc_id"))
    own = F.when(F.col("shared"), F.xxhash64("doc_id", "text_hash")).otherwise(F.col("doc_id"))
    return rows.join(repeated, "doc_id", "left").withColumn("node", own).drop("shared")


def verified(pairs: DataFrame, texts: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold. Texts are joined by shuffles; AQE splits the partitions of a hot one."""
    x, y = (texts.select(F.col("node").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")
    both = pairs.join(x, "a").join(y, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last = [], (None, None)
            for x, y in zip(batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary()), strict=True):
                if last[0] is None or last[0] != x:
                    last = (x, shingle_set(x.as_py(), shingle_words))
                p, q = last[1], shingle_set(y.as_py(), shingle_words)
                common = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(released(run), "a long, b long")


def plausible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes allow the threshold and whose sketches make it likely enough to verify."""
    least = may_reach(percent / 100)
    x, y = (reps.select(F.col("node").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("sig").alias(f"sig_{k}")) for k in "ab")
    sized = pairs.join(x, "a").join(y, "b").filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(batch.num_rows, -1) for i in (4, 5))
                j = estimate(a, b, batch.column(2).to_numpy(), batch.column(3).to_numpy())
                yield batch.select([0, 1]).filter(pa.array(j >= least))

    return sized.select("a", "b", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(released(run), "a long, b long")


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """Connected components of links (a, b) as (id, component), component being the smallest id; ids without links are left out.

    Large-star and small-star steps in turn, until every id has one component that has none itself. Each round is
    written, so it isn't computed again. The least neighbour of an id is found by partial minima and then joined to
    its edges; those of a leader with many followers are rows of ids alone, whose partitions AQE splits.
    """
    edges = scratch.write(links.select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("component")).filter("id != component").distinct())
    while True:
        ends = edges.select("id").union(edges.select("component").distinct())
        # In stars, an id stands once among the followers and the distinct leaders.
        if ends.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
            return edges
        both = edges.union(edges.select("component", "id"))
        least = both.groupBy("id").agg(F.least(F.min("component"), F.first("id")).alias("m"))
        large = both.filter("component > id").join(least, "id").select(F.col("component").alias("id"), F.col("m").alias("component"))
        large = large.union(least.filter("m < id").select("id", F.col("m").alias("component"))).repartition("id").distinct()
        m = large.groupBy("id").agg(F.min("component").alias("m"))
        small = large.join(m, "id").filter("component != m").select(F.col("component").alias("id"), F.col("m").alias("component")).union(m).distinct()
        after = scratch.write(small)
        scratch.drop(edges)
        edges = after


def small_sets(texts: DataFrame, shingle_words: int) -> DataFrame:
    """node and the SET least 32-bit hashes of the shingles of each text (node, text), ascending: all of them, for most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique((shingle_set(t.as_py(), shingle_words) >> np.uint64(32)).astype("<u4"))[:SET].tobytes() for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "small"])

    return texts.select("node", "text").mapInArrow(released(run), "node long, small binary")


#: Columns of the members of cells: bucket, numbers of two blocks, the bucket's leader; then those of a member, own being its block.
CELL = ("band", "no", "p", "q", "leader")
MEMBER = ("node", "component", "n_shingles", "sig", "own")


class Cell:
    """Members of one or two blocks of a bucket, as rows of MEMBER and, where sets are compared, the small set."""

    def __init__(self, rows: list[tuple], percent: int):
        self.ids, self.sizes, self.block = (np.array([r[i] for r in rows]) for i in (0, 2, 4))
        _, self.root = np.unique([r[1] for r in rows], return_inverse=True)
        self.sig = np.frombuffer(b"".join(r[3] for r in rows), "<u2").reshape(len(rows), -1)
        parts = self.sig.reshape(len(rows), BANDS, ROWS).astype(np.uint64)
        self.bands = (parts << np.arange(0, BITS * ROWS, BITS, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)
        self.percent, self.least = percent, may_reach(percent / 100)
        if len(rows[0]) > len(MEMBER):
            sets = [np.frombuffer(r[5], "<u4") for r in rows]
            self.cut = np.array([len(x) >= SET for x in sets])
            self.values, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
            self.ends = np.cumsum([len(x) for x in sets])
            self.starts = self.ends - [len(x) for x in sets]

    def turns(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each member of the first block with those that it meets: the second block or, where there is one, the members after it."""
        p, q = self.block.min(), self.block.max()
        for i in np.flatnonzero(self.block == p):
            yield i, np.flatnonzero(self.block == q) if p != q else np.arange(i + 1, len(self.ids))

    def meeting(self, band: int, leader: int) -> np.ndarray:
        """The members that have a candidate."""
        out = np.zeros(len(self.ids), bool)
        for i, others in self.turns():
            j = self.candidates(i, others, band, leader)
            out[j], out[i] = True, out[i] | bool(len(j))
        return np.flatnonzero(out)

    def candidates(self, i: int, others: np.ndarray, band: int, leader: int) -> np.ndarray:
        """Those of the others in another component whose sizes and registers allow a link, if this is the first band that they share."""
        if self.ids[i] == leader:  # it has met them all
            return others[:0]
        n, m = self.sizes[i], self.sizes[others]
        j = others[(self.root[others] != self.root[i]) & (np.minimum(n, m) * 100 >= np.maximum(n, m) * self.percent) & (self.ids[others] != leader)]
        j = j[(self.bands[j] == self.bands[i]).argmax(axis=1) == band]
        if not len(j):
            return j
        return j[estimate(np.broadcast_to(self.sig[i], (len(j), self.sig.shape[1])), self.sig[j], np.full(len(j), n), self.sizes[j]) >= self.least]

    def links(self, band: int, leader: int) -> Iterator[tuple[int, int]]:
        """Pairs to confirm on full sets. Among small sets those that merge components, otherwise all that may be links."""
        inside = np.zeros(len(self.values), bool)
        for i, others in self.turns():
            j = self.candidates(i, others, band, leader)
            if not len(j):
                continue
            own = self.flat[self.starts[i] : self.ends[i]]
            inside[own] = True
            for k in j[np.argsort(self.ids[j])]:
                if self.root[k] == self.root[i]:
                    continue
                other = self.flat[self.starts[k] : self.ends[k]]
                if self.cut[i] or self.cut[k]:  # compared as far as both sets reach
                    upto = min(own[-1] if self.cut[i] else len(self.values), other[-1] if self.cut[k] else len(self.values))
                    common = int(np.count_nonzero(inside[other[other <= upto]]))
                    union = np.count_nonzero(own <= upto) + np.count_nonzero(other <= upto) - common
                    share = self.percent / 100
                    if common >= (share - 4.5 * np.sqrt(share * (1 - share) / max(union, 1))) * union:
                        yield int(self.ids[i]), int(self.ids[k])
                    continue
                common, both = int(np.count_nonzero(inside[other])), int(self.sizes[i] + self.sizes[k])
                if 100 * (common + 1) >= self.percent * (both - common - 1):  # two hashes of a set may have been one
                    yield int(self.ids[i]), int(self.ids[k])
                    if 100 * (common - 1) >= self.percent * (both - common + 1):  # a link even if one hash in common is by chance
                        self.root[self.root == self.root[k]] = self.root[i]
            inside[own] = False


def by_cell(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """The cells of batches sorted by CELL: the cell's key and its members."""
    key, members = None, []
    for batch in rows:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[: len(CELL)] != key:
                if members:
                    yield key, members
                key, members = row[: len(CELL)], []
            members.append(row[len(CELL) :])
    if members:
        yield key, members


def open_pairs(hits: DataFrame, merged: DataFrame, reps: DataFrame, texts: DataFrame, shingle_words: int, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs to confirm (a, b) among members of buckets that still hold several components.

    A bucket's largest component is its main one, whose members need no comparison with each other. The others are
    dealt out over blocks of BLOCK members and meet each other and the main one's blocks in cells of two blocks, so
    that no task holds more of a bucket. In a cell, registers are compared first; only members that then still have a
    candidate get their small sets and are compared by them. Pairs that are linked join their components at once and
    only they are returned; a text of more than SET shingles is estimated from the SET least, with all pairs that may
    be links.
    """
    labelled = scratch.write(hits.filter("size > 2").join(merged.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node")))
    parts = labelled.groupBy("band", "no", "component").agg(F.count("*").alias("n"))
    open_ = scratch.write(parts.groupBy("band", "no").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n")).filter("n > n_main"))
    members = labelled.join(open_, ["band", "no"]).withColumn("is_main", F.col("component") == F.col("main"))
    members = members.join(reps.select("node", "n_shingles", "sig"), "node")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    rest, mains = blocks(F.col("n") - F.col("n_main")), blocks(F.col("n_main"))
    own = F.when(F.col("is_main"), rest + F.pmod(F.xxhash64("node"), mains)).otherwise(F.pmod(F.xxhash64("node"), rest)).cast("int")
    dealt = (
        members.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("is_main"), rest).otherwise(rest + mains) - 1)))
        .select("band", "no", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "leader", *MEMBER)
    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in by_cell(batches):
            if len(rows) > 1 and len(found := Cell(rows, percent).meeting(key[1], key[4])):
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*[(*key, *rows[i]) for i in found], strict=True), schema, strict=True)], schema=schema)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in by_cell(batches):
            found = list(Cell(rows, percent).links(key[1], key[4])) if len(rows) > 1 else []
            yield pa.RecordBatch.from_arrays([pa.array([f(x) for x in found], pa.int64()) for f in (min, max)], names=["a", "b"])

    schema = pa.schema([(c, pa.binary() if c == "sig" else pa.int32() if c in ("no", "p", "q", "own") else pa.int64()) for c in (*CELL, *MEMBER)])
    typed = ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'int' if f.type == pa.int32() else 'long'}" for f in schema)
    in_cells = lambda df: df.repartition("band", "p", "q").sortWithinPartitions("band", "no", "p", "q", "node")
    near = scratch.write(in_cells(dealt).mapInArrow(released(meet), typed))
    sets = small_sets(texts.join(near.select("node").distinct(), "node"), shingle_words)
    return in_cells(near.join(sets, "node").select(*near.columns, "small")).mapInArrow(released(link), "a long, b long").distinct()


def grouped(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_hash and n_shingles of each row of docs, and the group of near copies that it belongs to.

    first_id and first_hash are those of the group's row with the smallest (doc_id, text_hash): its own, for a row that is
    linked with nothing. Rows without words or without a doc_id have none. See near_duplicates.
    """
    scratch = Scratch(docs.sparkSession, "near")
    sketched = scratch.write(sketches(docs, shingle_words))
    known = sketched.filter("n_shingles > 0 and doc_id is not null")
    repeated = known.groupBy("doc_id").agg(F.min("text_hash").alias("low"), F.max("text_hash").alias("high")).filter("low != high").select("doc_id", F.lit(True).alias("shared"))
    repeated = None if repeated.isEmpty() else scratch.write(repeated)
    first = F.struct("doc_id", "text_hash", "node")
    reps = with_nodes(known, repeated).groupBy("d1", "d2").agg(F.min(first).alias("first"), F.min("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    reps = scratch.write(reps.select("d1", "d2", "first.*", "n_shingles", "sig"))
    size = 2 * ROWS
    band = F.posexplode(F.array(*[F.xxhash64(F.lit(i), F.substring("sig", i * size + 1, size)) for i in range(BANDS)]))
    bands = reps.select("node", band.alias("no", "band"))
    buckets = bands.groupBy("band", "no").agg(F.min("node").alias("leader"), F.count("*").alias("size")).filter("size > 1")
    hits = scratch.write(bands.join(buckets, ["band", "no"]).select("band", "no", "node", "leader", "size"))

    texts = with_nodes(identified(docs).filter(F.col("doc_id").isNotNull() & F.col("text").rlike(WORD)), repeated)
    # Ids are hashed, a few for each partition, so that texts need not be sorted.
    shared = hits.select("node").distinct().hint("shuffle_hash")
    texts = scratch.write(texts.join(shared, "node", "left_semi").select("node", "text"))
    if repeated is not None or not known.groupBy("doc_id").count().filter("count > 1").isEmpty():
        texts = scratch.write(texts.dropDuplicates(["node"]))  # rows equal in both
    tested = hits.filter("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    links = scratch.write(verified(scratch.write(plausible(tested, reps, percent)), texts, shingle_words, percent))
    merged = components(scratch, links)
    more = scratch.write(verified(open_pairs(hits, merged, reps, texts, shingle_words, percent, scratch), texts, shingle_words, percent))
    if not more.isEmpty():
        merged = components(scratch, merged.toDF("a", "b").union(more))

    merged = merged.select(F.col("id").alias("node"), "component")
    members = merged.union(merged.select("component", "component").distinct())
    heads = reps.select("node", "doc_id", "text_hash").join(members, "node").groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("head"))
    group = reps.join(members.join(heads, "component").select("node", "head"), "node", "left")
    group = group.select("d1", "d2", F.coalesce("head.doc_id", "doc_id").alias("first_id"), F.coalesce("head.text_hash", "text_hash").alias("first_hash"))
    columns = ["doc_id", "text_hash", "n_shingles", "first_id", "first_hash"]
    alone = sketched.filter("n_shingles = 0 or doc_id is null").select(*columns[:3], F.lit(None).cast("long").alias("first_id"), F.lit(None).cast("long").alias("first_hash"))
    out = scratch.write(known.join(group, ["d1", "d2"]).select(*columns).union(alone))
    scratch.clear(out)
    return out


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """Groups of near copies among docs (doc_id, text; other columns are ignored).

    Returns doc_id, n_shingles, component_id and kept, a row for each row of docs. Texts are linked when 100 times
    the size of the intersection of their shingle sets is at least ``percent`` times that of the union; sets of equal
    128-bit digests count as equal. component_id is the smallest doc_id reachable over links; kept marks the document
    with that id. A null or wordless text has an empty set and no link. A row without doc_id is linked with nothing,
    has no component_id and is kept. Rows that repeat a doc_id are each grouped by their own text. An empty table gives
    an empty result.

    A pair at the threshold shares none of the 32 bands of 5 registers with a probability of about 3e-6.
    """
    rows = grouped(docs, shingle_words, percent).select("doc_id", "n_shingles", F.coalesce("first_id", "doc_id").alias("component_id"))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_copies(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, whole, but one of each group of near copies: that with the smallest doc_id.

    Of different texts with that doc_id in one group, the one with the smallest hash stays, and of rows equal in doc_id
    and text any one. Texts without a doc_id are grouped like others and come after those that have one. Rows without
    words all stay. The rows are joined with the ids and hashes of those that go; nothing else moves.
    """
    hidden = "_".join(["", *docs.columns])  # a name that no column has
    key, own = f"{hidden}_key", f"{hidden}_hash"
    late = F.shiftrightunsigned(F.xxhash64("text"), 2) + F.lit(1 << 62)
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), late)).withColumn(own, F.xxhash64("text"))
    rows = grouped(keyed.select(F.col(key).alias("doc_id"), "text"), shingle_words, percent).filter("first_id is not null")
    is_first = (F.col("doc_id") == F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))
    gone = rows.filter(~is_first).select(F.col("doc_id").alias(key), F.col("text_hash").alias(own)).distinct()
    again = rows.filter(is_first).groupBy(F.col("doc_id").alias(key), F.col("text_hash").alias(own)).agg(F.count("*").alias("n")).filter("n > 1").select(key, own)
    left = keyed.join(gone, [key, own], "left_anti")
    if not again.isEmpty():
        left = left.join(again, [key, own], "left_anti").union(left.join(again, [key, own], "left_semi").dropDuplicates([key, own]))
    return left.select(*docs.columns)
