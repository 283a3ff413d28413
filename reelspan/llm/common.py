r"""Arrow, numpy and storage helpers that the operators share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Odd, so invertible modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes of text that the numpy code works on at once.
BLOCK_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection on 64-bit words."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, U64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=U64)


INVERSE = pow(BASE, -1, 1 << 64)


class Roller:
    """Rolling polynomial hashes modulo 2**64 over a sequence of 64-bit codes."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.n, self.down = n, powers(n + 1, INVERSE)
        self.prefix = np.zeros(n + 1, U64)
        np.cumsum(codes * powers(n), out=self.prefix[1:])

    def at(self, starts: np.ndarray, width) -> np.ndarray:
        return mix((self.prefix[starts + width] - self.prefix[starts]) * self.down[starts])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows as one array, and each row's offsets in it; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``most`` bytes of text each; a longer row is a slice of its own."""
    _, offsets = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


#: Bytes of `[^\x20\x09-\x0D]` and, after lower-casing, of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]`.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Words:
    """The words of a column of texts: maximal runs of the given bytes within a row.

    starts and ends are byte positions in ``data``; row k has the words
    first[k] to first[k + 1].
    """

    def __init__(self, column: pa.Array, of: np.ndarray, lower: bool = False):
        self.data, self.offsets = text_bytes(column)
        if lower:
            self.data = LOWER[self.data]
        inside = of[self.data]
        edge = np.zeros(len(inside) + 1, bool)
        edge[self.offsets] = True
        before = np.zeros(len(inside), bool)
        before[1:] = inside[:-1]
        before[edge[:-1]] = False
        after = np.zeros(len(inside), bool)
        after[:-1] = inside[1:]
        after[edge[1:]] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.lengths = self.ends - self.starts
        self.bytes = self.data[inside]

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def array(self) -> pa.Array:
        offsets = np.zeros(len(self) + 1, np.int64)
        np.cumsum(self.lengths, out=offsets[1:])
        kind, small = (pa.binary(), np.int32) if offsets[-1] < 2**31 else (pa.large_binary(), np.int64)
        return pa.Array.from_buffers(kind, len(self), [None, pa.py_buffer(offsets.astype(small)), pa.py_buffer(np.ascontiguousarray(self.bytes))])

    def ids(self) -> np.ndarray:
        """A number for each distinct word of this column, equal for equal words."""
        return self.array().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def codes(self) -> np.ndarray:
        """A 64-bit code for each word that depends on its bytes alone."""
        if not len(self):
            return np.zeros(0, U64)
        words = self.array().dictionary_encode()
        known = words.dictionary
        data, offsets = text_bytes(known)
        roll = Roller(mix(data.astype(U64) + U64(0x51ED27)))
        lengths = np.diff(offsets)
        return mix(roll.at(offsets[:-1], lengths) + lengths.astype(U64))[words.indices.to_numpy(zero_copy_only=False)]


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Totals of values[first[k]:first[k + 1]] as int64."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs more than once."""
    out = np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys)
        s = keys[order]
        same = s[1:] == s[:-1]
        out[order[1:]] = same
        out[order[:-1]] |= same
    return out


def covered(starts: np.ndarray, width, n: int) -> np.ndarray:
    """True for the positions in [start, start + width) of any start."""
    step = np.bincount(starts, minlength=n + 1) - np.bincount(starts + width, minlength=n + 1)
    return np.cumsum(step[:-1]) > 0


def out_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) and c.type == f.type else c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for f in schema], schema=schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset and all runs in one process, as in tests, one of that process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            return jdir.get()
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(root)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return root


def remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when this process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """The rows, written as a table in the shared folder and read back: lineage ends here, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = path or scratch(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(*columns: str) -> "F.Column":
    """A 64-bit key of a row's content: equal rows share it."""
    return F.xxhash64(*columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
