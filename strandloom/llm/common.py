"""Shared pieces: tables, scratch space, packed text handling."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


#: Deletes the shuffle files of a query when the query has ended.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the folder in ``spark.checkpoint.dir``, which driver and executors share.

    Only a session in local mode may name none; it gets a temporary folder that goes
    with the process. ``done`` deletes what a result doesn't read; the rest stays in the shared folder.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            master = spark.sparkContext.master
            if not (master == "local" or master.startswith("local[")):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="strandloom-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            root = f"file://{folder}"
        self.root = f"{root}/strandloom-{uuid.uuid4().hex}"
        self.count = 0
        self.live: set[str] = set()

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once and return the written table; this cuts the lineage, and shuffle files go with the write."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        before = self.spark.conf.get(CLEAN, "false")
        self.spark.conf.set(CLEAN, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEAN, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        self.live.add(path)
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that ``save`` wrote and nothing will read again."""
        jvm = self.spark.sparkContext._jvm
        for path in {getattr(df, "scratch_path", None) for df in tables} & self.live:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
            self.live.discard(path)

    def done(self, *kept: DataFrame) -> None:
        """Delete all tables but these, which the result reads."""
        rest = self.live - {df.scratch_path for df in kept}
        self.drop(*[SimpleNamespace(scratch_path=path) for path in rest])


def fresh(columns, *wanted: str) -> list[str]:
    """Column names like ``wanted`` that stand in no table with ``columns``, whatever the case of its letters."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


# --- words of a packed Arrow column -----------------------------------------

_BASE = 0xD6E8FEB86659FD93
_BASE_INV = pow(_BASE, -1, 1 << 64)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Words:
    """The words of every row of a string column, found without a Python loop.

    data: bytes; start, end: byte span of each word; row: its row; hash: 64 bits
    of its bytes, equal on every machine. Nulls have no words.
    """

    def __init__(self, column: pa.Array, lower: bool = False, hashes: bool = True):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_string()).fill_null("")
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
        lo, hi = int(offsets[0]), int(offsets[-1])
        raw = column.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8)[lo:hi] if raw is not None and hi > lo else np.zeros(0, np.uint8)
        self.offsets = offsets - lo
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        self.data, self.rows = data, n
        solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
        first, last = solid.copy(), solid.copy()
        if len(data):
            first[1:] &= ~solid[:-1]
            last[:-1] &= ~solid[1:]
            edge = self.offsets[:-1][np.diff(self.offsets) > 0]
            first[edge] = solid[edge]
            last[edge[edge > 0] - 1] = solid[edge[edge > 0] - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.row = np.searchsorted(self.offsets, self.start, side="right") - 1
        self.first = np.searchsorted(self.row, np.arange(n + 1))
        if hashes:
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + _U(1)) * _powers(_BASE, len(data)), out=total[1:])
            undo = _powers(_BASE_INV, len(data) + 1)
            self.hash = mix((total[self.end] - total[self.start]) * undo[self.start] + (self.end - self.start).astype(np.uint64))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Position of each run of k words of one row, and its hash."""
        n = len(self.start) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = (out + self.hash[j : j + n]) * _U(_BASE)
        at = np.flatnonzero(self.row[:n] == self.row[k - 1 : k - 1 + n])
        return at, mix(out[at])

    def texts(self, lo: int, hi: int) -> bytes:
        """The bytes from the first to the last of some words."""
        return self.data[self.start[lo] : self.end[hi - 1]].tobytes() if hi > lo else b""


def pieces(batch: pa.RecordBatch, column: str, most_bytes: int = 2 << 20, most_rows: int = 50_000):
    """Slices of a batch whose texts have at most so many bytes; a longer text stands alone."""
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
    at = 0
    ends = np.cumsum(size)
    while at < len(size):
        base = ends[at - 1] if at else 0
        to = int(np.searchsorted(ends, base + most_bytes, side="right"))
        to = min(max(to, at + 1), at + most_rows, len(size))
        yield batch.slice(at, to - at)
        at = to

