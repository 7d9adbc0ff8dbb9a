"""Pieces shared by the corpus operators: byte-level word tables over Arrow buffers, hashing, scratch tables.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. A null text counts as an empty one everywhere.
"""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_P = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset and all runs in one process, as in tests, a
    folder of our own; on a cluster that would lose data, so it is an error there."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="weftlink-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


class Scratch:
    """Written tables that cut lineage. A lost executor costs nothing of what has been written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df in the shared folder and return a reader of it, with df's schema."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Remove a table that no later step reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets of its rows; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if isinstance(col, pa.ChunkedArray):  # no rows
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    col = col.cast(pa.large_binary())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = col.buffers()
    offsets = np.frombuffer(at, np.int64, len(col) + 1, col.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes; a longer row stands alone, so that memory follows one row at most."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and how many words each row has. A word never crosses rows."""
    n, rows = len(data), len(offsets) - 1
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(rows, np.int64)
    full = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n + 1, bool)
    before[0], before[1:] = False, full
    after = np.empty(n + 1, bool)
    after[:n], after[n] = full, False
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, base: np.uint64 = _P) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty, non-overlapping byte span, equal for equal bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    inner = np.arange(int(lens.sum())) - np.repeat(first, lens)
    at = inner + np.repeat(starts, lens)
    pw = powers(int(lens.max()))
    return mix(np.add.reduceat((data[at].astype(np.uint64) + np.uint64(1)) * pw[inner], first))


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of k lower-cased words of each row, as sorted 64-bit hashes, and n + 1 offsets.

    A row with fewer than k words has its whole word sequence as one shingle; a row without words has none.
    """
    rows = len(offsets) - 1
    low = LOWER[data]
    starts, ends, per = words(low, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    h = span_hash(low, starts, ends)
    pad = np.concatenate([h, np.zeros(k - 1, np.uint64)])
    salt = mix(np.arange(1, k + 1, dtype=np.uint64) * _P) | np.uint64(1)
    roll = np.zeros(len(h), np.uint64)
    first = np.cumsum(per) - per
    row = np.repeat(np.arange(rows), per)
    left = (first + per)[row] - np.arange(len(h))  # words from here to the row's end
    for j in range(k):
        roll += np.where(left > j, mix(pad[j : j + len(h)] + salt[j]) * salt[j], np.uint64(j + 1))
    roll = mix(roll)
    whole = (left >= k) | ((np.arange(len(h)) == first[row]) & (per[row] < k))
    roll, row = roll[whole], row[whole]
    order = np.lexsort((roll, row))
    roll, row = roll[order], row[order]
    new = np.ones(len(roll), bool)
    new[1:] = (roll[1:] != roll[:-1]) | (row[1:] != row[:-1])
    roll, row = roll[new], row[new]
    return roll, np.searchsorted(row, np.arange(rows + 1))


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of doc_id as text leaves 0 when divided by 5; a null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))
