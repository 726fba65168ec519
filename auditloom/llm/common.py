"""Helpers shared by the text operators: a scratch area on shared storage and word hashing in numpy."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

_local_root: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset on a local master (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _local_root:
        _local_root.append(tempfile.mkdtemp(prefix="auditloom-"))
    return "file://" + _local_root[0]


class Scratch:
    """Written tables that cut the lineage of one operator call.

    ``write`` stores a frame as Parquet and returns a frame that reads it, so an executor that is lost later costs
    a re-read and not a recomputation. ``drop`` removes tables that no later step reads, ``clear`` all but some.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.count, self.paths = 0, []

    def write(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count}"
        schema = df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path  # noqa: SLF001
        self.paths.append(path)
        return out

    def _delete(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)  # noqa: SLF001
        self.paths.remove(path)

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self._delete(df._scratch_path)  # noqa: SLF001

    def clear(self, *kept: DataFrame) -> None:
        for path in set(self.paths) - {df._scratch_path for df in kept}:  # noqa: SLF001
            self._delete(path)


def n_words(text: Column | str) -> Column:
    """Number of words of a text, in the JVM; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: The setting that bounds Arrow batches, Spark's own value of it, and ours: a batch of texts lies in memory several times.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Arrow batches of the session get smaller, unless it has a size of its own."""
    if spark.conf.get(BATCH[0]) == BATCH[1]:
        spark.conf.set(BATCH[0], BATCH[2])
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, which gives the memory that it has freed back to the machine when a task ends.

    Workers are kept for later tasks and keep free memory with them, next to executors that may need it in the meantime.
    """

    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return task


# --- hashing of words, vectorised over a whole Arrow batch -------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the splitmix64 output function)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


_seeded = np.random.default_rng(20240607)
_BYTE = _seeded.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, grown as needed and then kept."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


class Words:
    """The words of UTF-8 bytes: byte positions where they start and end, and hashes of them and of their beginnings.

    letters: for each of the 256 bytes, whether it belongs to words.
    """

    def __init__(self, raw: bytes, letters: np.ndarray = ~_SPACE):
        data = np.frombuffer(raw, np.uint8)
        edge = np.diff(letters[data].astype(np.int8), prepend=0, append=0)
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        up, self._down = _power_tables(len(data) + 1)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self._sums[1:])

    def __len__(self) -> int:
        return len(self.starts)

    def slices(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self._sums[ends] - self._sums[starts]) * self._down[starts] + (ends - starts).astype(np.uint64))

    def hashes(self) -> np.ndarray:
        return self.slices(self.starts, self.ends)

    def prefixes(self, k: int) -> np.ndarray:
        """Hashes of the first k bytes of the words that are longer."""
        at = self.starts[self.ends - self.starts > k]
        return mix64(self.slices(at, at + k) + np.uint64(k))


def rolled(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each window of k consecutive words, in order; the whole sequence as one where there are fewer."""
    if not len(words):
        return words
    k = min(k, len(words))
    out = words[: len(words) - k + 1]
    for i in range(1, k):
        out = mix64(out * _BASE + words[i : len(words) - k + 1 + i])
    return out

