"""Shared helpers: reading tables, cutting lineage, word hashing inside Arrow tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import Staged, Wide  # noqa: F401

#: Java and Python form of the one word pattern that every operator uses.
SPACE = r"[\x20\x09-\x0D]+"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bytes of text that a task takes apart at once; a longer text is taken alone.
SLICE_BYTES = 800_000
#: Bits of the table that picks rows whose sets may be needed.
PICK_BITS = 1 << 22

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ROLL = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Where the session doesn't say otherwise, Arrow batches are kept small, as texts are long."""
    if spark.conf.get(BATCH_ROWS) == "10000":  # Spark's default
        spark.conf.set(BATCH_ROWS, 1000)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the folds of learned operators."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output's."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """One hash for each run of k consecutive words; none if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return h[:0]
    out = h[:n].copy()
    for j in range(1, k):
        out = mix(out * _ROLL + h[j : n + j])
    return out


class Words(NamedTuple):
    """The words of some texts, in order: hashes, where each begins and how many bytes it has; and how many each text has."""

    hash: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    count: np.ndarray

    def first(self) -> np.ndarray:
        """The first word of each text."""
        return np.cumsum(self.count) - self.count

    def place(self) -> np.ndarray:
        """Places of the words within their texts."""
        return np.arange(len(self.hash)) - np.repeat(self.first(), self.count)


_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def span_hashes(padded: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of byte spans; eight more bytes follow the last one."""
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))  # the eight bytes from each place on
    h = mix((eight[begin] & _FIRST_BYTES[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * _ROLL))
    long, done = np.flatnonzero((size > 8) & (size <= 64)), 8
    while len(long):
        h[long] = mix(h[long] * _ROLL + (eight[begin[long] + done] & _FIRST_BYTES[np.minimum(size[long] - done, 8)]))
        done += 8
        long = long[size[long] > done]
    for i in np.flatnonzero(size > 64):
        h[i] = xxhash.xxh64_intdigest(padded[begin[i] : begin[i] + size[i]])
    return h


def words_of(data: np.ndarray, ends: np.ndarray, lower: bool = False) -> Words:
    """Words of the texts that end at `ends` in the bytes; equal words have equal hashes everywhere. lower: A-Z counts as a-z."""
    n = len(data)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = _LOWER[data] if lower else data
    solid = ~_SPACES[data]
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1]
    closes[:-1] &= ~solid[1:]
    edge = np.r_[0, ends]
    at = edge[:-1][edge[:-1] < n]
    opens[at] = solid[at]
    at = edge[1:][edge[1:] > 0] - 1
    closes[at] = solid[at]
    begin = np.flatnonzero(opens)
    size = np.flatnonzero(closes) + 1 - begin
    h = span_hashes(padded, begin, size)
    return Words(h, begin, size, np.diff(np.searchsorted(begin, edge)))


def text_slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows of a text column, about `size` bytes together: which, their bytes, and where each text ends in these; nulls are empty."""
    column = column.fill_null("") if column.null_count else column
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    edge = np.zeros(len(column) + 1, np.int64)
    if offsets is not None:
        edge[:] = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1]
    every = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(edge, edge[at] + size, side="right")) - 1)
        yield slice(at, stop), every[edge[at] : edge[stop]], edge[at + 1 : stop + 1] - edge[at]
        at = stop


def text_words(batch: pa.RecordBatch, lower: bool = False, text: str = "text") -> Iterator[tuple[slice, Words]]:
    """The words of a batch's texts, a slice of its rows at a time."""
    for rows, data, ends in text_slices(batch.column(batch.schema.get_field_index(text))):
        yield rows, words_of(data, ends, lower)


def column(batch: pa.RecordBatch, name: str, rows: slice) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name)).slice(rows.start, rows.stop - rows.start)


def sums(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums over runs of the given lengths; runs may be empty."""
    out = np.zeros(len(count), values.dtype)
    some = np.flatnonzero(count)
    if len(some):
        out[some] = np.add.reduceat(values, (np.cumsum(count) - count)[some])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def give_back() -> None:
    """Returns freed memory to the system: a worker process goes on to other tasks, whose executor it shares."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def parts(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """A task's batches, some rows at a time; what earlier tasks of the process have freed is given back first."""
    give_back()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[list, ...]]:
    """Python lists of the named columns, some rows at a time."""
    for batch in parts(batches):
        yield tuple(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)


def picked(rows: DataFrame, key: Column, ids: DataFrame, id_: str) -> DataFrame:
    """The rows with `may`: false where the key is surely not among the ids. The table broadcast has PICK_BITS / 64 rows at most."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(PICK_BITS))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (place(c) % 64).cast("int"))
    table = ids.groupBy(F.floor(place(F.col(id_)) / 64).alias("at")).agg(F.bit_or(bit(F.col(id_))).alias("bits"))
    at = F.when(key.isNotNull(), F.floor(place(key) / 64))
    joined = rows.withColumn("key_at", at).join(F.broadcast(table), F.col("key_at") == F.col("at"), "left")
    may = F.coalesce(F.col("bits").bitwiseAND(bit(key)) != 0, F.lit(False))
    return joined.withColumn("may", may).drop("key_at", "at", "bits")


def split_words(text: Column) -> Column:
    """The words of a text as an array, in Spark SQL; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")

