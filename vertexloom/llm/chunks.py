"""Corpus-wide questions about n-grams or symbols, asked in chunks and answered in hash buckets.

A chunk is one row with the coded words of many texts. It asks about its distinct keys only, sorted and
packed, split by the top bits of the keys; a bucket sees the keys of all chunks, and its answers go
back in the order of the questions. So what is shuffled grows with the distinct keys of a chunk,
a frequent key is one entry a chunk, and chunks and buckets have bounded sizes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import Words, give_back, parts, text_words

#: Words of a chunk of texts (one text may be longer), and keys that a bucket is meant to get.
CHUNK_WORDS, BUCKET_KEYS = 1_000_000, 1_000_000

ASK = "k int, b long, chunk long, keys binary, n binary"
ANSWER = "k int, b long, chunk long, answer binary, distinct long"


def pack(x: np.ndarray) -> bytes:
    """Numbers as compressed bytes, all lowest bytes first, then all second ones and so on."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpack(b: bytes, kind) -> np.ndarray:
    n, size = int.from_bytes(b[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(b[8:], n * size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=x[:1] * np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, np.uint64), dtype=np.uint64)


def slices(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Buckets by the top bits of the sorted keys, and the keys of each."""
    b = (keys >> np.uint64(64 - bits)).astype(np.int64)
    edges = [0, *(np.flatnonzero(np.diff(b)) + 1).tolist(), len(b)] if len(b) else []
    for lo, hi in pairwise(edges):
        yield int(b[lo]), slice(lo, hi)


def bucket_bits(size: int) -> int:
    return max(4, int(np.ceil(np.log2(max(1, size / BUCKET_KEYS)))))


def coded(docs: DataFrame, size: int, take: Callable[[pa.RecordBatch, slice, Words], tuple[np.ndarray, np.ndarray, dict[str, pa.Array]]], values: str, lower: bool) -> DataFrame:
    """Rows of about `size` words: words, codes, sizes (packed), n, and lists of the values of each text.

    take: (batch, rows, words) -> word hashes of the texts to be coded, their number for each, and
    their values. values: the schema of these, in single texts.
    """
    names = [v.split()[0] for v in values.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, sizes, held, n = [], [], [], 0

        def flush() -> pa.RecordBatch:
            words, codes = np.unique(np.concatenate(flat), return_inverse=True)
            lists = [pa.concat_arrays([h[v] for h in held]) for v in names]
            columns = [pa.array([x], pa.binary()) for x in (pack_sorted(words), pack(codes.astype(np.uint32)), pack(np.concatenate(sizes)))]
            columns += [pa.array([n], pa.int64())] + [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
            return pa.RecordBatch.from_arrays(columns, ["words", "codes", "sizes", "n", *names])

        for batch in parts(batches):
            for rows, words in text_words(batch, lower):
                h, count, own = take(batch, rows, words)
                if not len(count):
                    continue
                flat.append(h)
                sizes.append(count)
                held.append(own)
                n += len(h)
                if n >= size:
                    yield flush()
                    flat, sizes, held, n = [], [], [], 0
        if held:
            yield flush()

    return docs.mapInArrow(run, "words binary, codes binary, sizes binary, n long, " + ", ".join(f"{v.split()[0]} array<{v.split()[1]}>" for v in values.split(", ")))


def code_arrays(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word hashes, the code of each word, and the texts' numbers of words."""
    return unpack_sorted(row["words"]), unpack(row["codes"], np.uint32).astype(np.int64), unpack(row["sizes"], np.int64)


def asked(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["k", "b", "chunk", "keys", "n"])


def ask_all(chunks: DataFrame, ask: Callable[[dict], list[tuple]]) -> DataFrame:
    """What the chunks ask without an answer so far: (k, b, chunk, keys, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in parts(batches, 1):
            yield from asked(ask(row.to_pylist()[0])).to_batches()

    return chunks.mapInArrow(run, ASK)


def ask_with(chunks: DataFrame, answers: DataFrame, ask: Callable[[dict, pa.Table], list[tuple]]) -> DataFrame:
    """What the chunks ask in the light of answers."""

    def run(rows: pa.Table, got: pa.Table) -> pa.Table:
        give_back()
        return asked(ask(rows.to_pylist()[0], got))

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, ASK)


def answered(asks: DataFrame, combine: Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, int]]) -> DataFrame:
    """Answers by bucket.

    combine: (packed n of each question, order that sorts the keys, first places of equal ones in it,
    number of each of them) -> an answer for each in that order, and how many distinct keys count.
    """

    def run(table: pa.Table) -> pa.Table:
        give_back()
        keys = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
        sizes, flat = [len(k) for k in keys], np.concatenate(keys)
        order = np.argsort(flat, kind="stable")
        new = np.ones(len(flat), bool)
        new[1:] = flat[order][1:] != flat[order][:-1]
        del keys, flat
        values, distinct = combine(table.column("n").to_pylist(), order, np.flatnonzero(new), np.cumsum(new) - 1)
        back = np.empty(len(order), values.dtype)
        back[order] = values
        parts = [pack(x) for x in np.split(back, np.cumsum(sizes)[:-1])]
        return pa.table({"k": table.column("k"), "b": table.column("b"), "chunk": table.column("chunk"), "answer": pa.array(parts, pa.binary()), "distinct": pa.array([distinct] + [0] * (len(sizes) - 1), pa.int64())})

    return asks.groupBy("k", "b").applyInArrow(run, ANSWER)


def answers_of(got: pa.Table, k: int, n: int, kind) -> np.ndarray:
    """The answers about a chunk's n keys of kind k, in the order of the keys."""
    mine = got.filter(pc.equal(got.column("k"), k)).sort_by("b").column("answer").to_pylist()
    out = np.concatenate([np.zeros(0, kind), *(unpack(x, kind) for x in mine)])
    assert len(out) == n
    return out

