"""Substring deduplication by recompression.

Words that stand in a window of 13 words which also starts in a document with a smaller id are
removed. Every text is recompressed level by level: runs of equal symbols become one symbol, then
each pair of a left and a right symbol becomes one, the side being a bit of the symbol. The name of
a symbol is a 64-bit fingerprint of what it spells, so all texts call equal runs and pairs alike; Spark
rounds then settle globally which names stand, namely those that occur in two documents. A symbol is
fixed by the words it spells and by its neighbours, so equal substrings have equal symbols but near
their ends.

1. Chunks of texts send their distinct words and level 1 symbols to hash buckets and learn which
   names stand; then the symbols of levels 2 and 3 that are made of standing ones.
2. A window is a candidate only if every symbol, of any level, that the window alone fixes has a name
   that stands: shared high-level symbols reveal repeats, lower ones confirm them at the borders.
3. A candidate is named by the largest symbols that it fixes and their places in it: equal windows fix
   equal symbols, so these names reveal the repeats. Chunks send the distinct names of their candidates,
   each with a fingerprint of the window's words and the smallest id, and learn whether a document with a
   smaller id has a window of the same symbols and, verified downwards, of the same words. Words it
   covers are removed. Name and fingerprint are CHECK_BITS + 64 bits, which share word hashes only.

What is shuffled are distinct names and windows of a chunk, never tokens; a hot name or window is one
entry a chunk.

Cases: null, empty and blank texts and texts of fewer than 13 words lose nothing; windows repeated
within one document only are kept; rows with equal ids are one document for the comparison, and
each is cut by its own text; a null id is compared with nothing; equal texts lose all words but in
the smallest id; very long texts are handled whole; an empty table gives no rows; further columns
are ignored by `repeats` and kept by `remove`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import chunks as C
from .common import Staged, Words, column, give_back, mix, parts, picked, rows_of, utf8, windows

WINDOW = 13
#: The levels that a Spark round settles: words and their runs and pairs, then the two levels above.
LOW, HIGH = range(2), range(2, 4)
#: A task holds some 250 bytes for each word of a chunk.
CHUNK_WORDS = 250_000
#: The kind of question that is about windows; names of level k are questions of kind k.
WINDOWS = 9

_ROLL = np.uint64(0xD1B54A32D192ED03)
#: Weight of a place in a window's name, and its inverse modulo 2^64.
_PLACE = 0x9FB21C651E98DF25
_BACK = pow(_PLACE, -1, 1 << 64)
#: Bits of the fingerprint of words that goes with a window's name.
CHECK_BITS = 32
CHECKED = np.dtype([("least", np.int64), ("check", np.uint32)])


class Level:
    """Symbols in text order: the words they spell [start, end), and the words that fix them [low, high).

    `made` are the runs and pairs made on this level; for these, `parts` are the first and last
    symbol of the level below that they consist of.
    """

    def __init__(self, name: np.ndarray, text: np.ndarray, start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray, made: np.ndarray, first: np.ndarray, last: np.ndarray):
        self.name, self.text, self.start, self.end, self.low, self.high, self.made, self.first, self.last = name, text, start, end, low, high, made, first, last

    def next(self, k: int) -> Level:
        """The level above, which is level k."""
        n = len(self.name)
        opens = np.ones(n, bool)  # of a text
        opens[1:] = self.text[1:] != self.text[:-1]
        closes = np.ones(n, bool)
        closes[:-1] = opens[1:]
        # a neighbour fixes where a run ends and what a symbol is paired with; at the ends of a text nothing fixes it
        low, high = np.full(n, -1, np.int32), np.full(n, 2**31 - 1, np.int32)
        low[1:] = self.low[:-1]
        high[:-1] = self.high[1:]
        low[opens], high[closes] = self.start[opens] - 1, self.end[closes] + 1
        head = opens.copy()
        head[1:] |= self.name[1:] != self.name[:-1]
        at = np.flatnonzero(head)
        last = np.r_[at[1:], n] - 1
        size = last - at + 1
        base, name = self.name[at], self.name[at].copy()
        run = size > 1
        name[run] = mix(base[run] * _ROLL + size[run].astype(np.uint64))
        right = (mix(base + np.uint64(k)) & np.uint64(1)).astype(bool)  # a run stands on its symbol's side
        pair = np.zeros(len(at), bool)
        pair[:-1] = ~right[:-1] & right[1:] & ~opens[at[1:]]
        two = np.flatnonzero(pair)
        name[two] = mix(name[two] * _ROLL ^ mix(name[two + 1]))
        until = last.copy()
        until[two] = last[two + 1]
        stays = np.ones(len(at), bool)
        stays[two + 1] = False
        at, until, made = at[stays].astype(np.int32), until[stays].astype(np.int32), (pair | run)[stays]
        return Level(name[stays], self.text[at], self.start[at], self.end[until], low[at], high[until], made, at, until)


def levels(words: np.ndarray, count: np.ndarray, top: int = HIGH[-1]) -> list[Level]:
    """Levels 0 (the words) to `top` of texts with these numbers of words."""
    i = np.arange(len(words), dtype=np.int32)
    out = [Level(words, np.repeat(np.arange(len(count), dtype=np.int32), count), i, i + 1, i, i + 1, np.ones(len(words), bool), i, i)]
    for k in range(1, top + 1):
        out.append(out[-1].next(k))
    return out


class Distinct:
    """Distinct keys, sorted, the place of each key among them, and least and greatest owner; keys with different checks differ."""

    def __init__(self, keys: np.ndarray, owner: np.ndarray, check: np.ndarray | None = None):
        order = np.argsort(keys) if check is None else np.lexsort((check, keys))
        flat = keys[order]
        new = np.ones(len(flat), bool)
        new[1:] = flat[1:] != flat[:-1]
        if check is not None:
            new[1:] |= np.diff(check[order]) != 0
        first = np.flatnonzero(new)
        self.keys, self.which = flat[first], np.empty(len(flat), np.int64)
        self.check = None if check is None else check[order][first]
        self.which[order] = np.cumsum(new) - 1
        self.least = np.minimum.reduceat(owner[order], first) if len(first) else owner[:0]
        self.most = np.maximum.reduceat(owner[order], first) if len(first) else owner[:0]

    def ask(self, kind: int, chunk: int, bits: int, values: np.ndarray) -> Iterator[tuple]:
        for b, s in C.slices(self.keys, bits):
            yield kind, b, chunk, C.pack_sorted(self.keys[s]), C.pack(values[s])


class Chunk:
    """The symbols of a chunk's texts up to level `top`, those of each level that may stand, and what is known of them."""

    def __init__(self, row: dict, top: int = HIGH[-1]):
        self.id, self.ids, self.prints = row["chunk"], np.array(row["ids"], np.int64), row["prints"]
        distinct, codes, self.count = C.code_arrays(row)
        self.levels = levels(distinct[codes], self.count, top)
        self.stands = [np.ones(len(x.name), bool) for x in self.levels]  # until told otherwise
        self.asks: list[tuple[np.ndarray, Distinct]] = []

    def look(self, k: int) -> Distinct:
        """The distinct made symbols of a level, of parts that stand."""
        level = self.levels[k]
        if k:
            below = self.stands[k - 1]
            # of a run all parts are alike, of a pair the first and last tell
            self.stands[k] = below[level.first] & below[level.last]
        at = np.flatnonzero(level.made & self.stands[k])
        out = Distinct(level.name[at], self.ids[level.text[at]])
        self.asks.append((at, out))
        return out

    def question(self, k: int, bits: int) -> Iterator[tuple]:
        d = self.look(k)
        return d.ask(k, self.id, bits, (d.least != d.most).astype(np.uint8))

    def told(self, levels_: range, got: pa.Table) -> None:
        """Takes in the answers of one round, in which these levels were asked about."""
        looked = [(k, self.look(k)) for k in levels_]
        for k, d in looked:
            at, _ = self.asks[k]
            self.stands[k][at] = C.answers_of(got, k, len(d.keys), np.uint8)[d.which] > 0
            if k:
                below = self.stands[k - 1]
                self.stands[k] &= below[self.levels[k].first] & below[self.levels[k].last]

    def candidates(self) -> np.ndarray:
        """Starts of the windows all of whose symbols stand."""
        n = int(self.count.sum())
        stop = np.cumsum(self.count)
        begin = stop - self.count
        change = np.zeros(n + 1, np.int64)
        for level, stands, (at, _) in zip(self.levels, self.stands, self.asks, strict=True):
            bad = at[~stands[at]]
            # the windows that fix a symbol begin from `low` down to `high - WINDOW`
            lo = np.maximum(level.high[bad] - WINDOW, begin[level.text[bad]])
            hi = np.minimum(level.low[bad], stop[level.text[bad]] - WINDOW)
            some = lo <= hi
            change += np.bincount(lo[some], minlength=n + 1) - np.bincount(hi[some] + 1, minlength=n + 1)
        free = np.cumsum(change)[:-1] == 0
        free &= np.arange(n) <= np.repeat(stop - WINDOW, self.count)
        return np.flatnonzero(free)

    def signatures(self) -> np.ndarray:
        """For each word, the name of the window that starts there: its largest fixed symbols, weighted by place.

        A symbol's term counts for all windows that fix it, in place of the terms of its parts.
        """
        n, stop = len(self.levels[0].name), np.cumsum(self.count)
        begin = stop - self.count
        place = np.full(n, _PLACE, np.uint64).cumprod()
        term = self.levels[0].name * place
        below = np.r_[np.uint64(0), term.cumsum()]
        out = below[np.minimum(np.arange(n) + WINDOW, n)] - below[:-1]
        change = np.zeros(n + 1, np.uint64)
        for level in self.levels[1:]:
            term = level.name * place[level.start]
            lo = np.maximum(level.high - WINDOW, begin[level.text])
            hi = np.minimum(level.low, stop[level.text] - WINDOW)
            at = np.flatnonzero(level.made & (lo <= hi))
            more = term[at] - (below[level.last[at] + 1] - below[level.first[at]])
            np.add.at(change, lo[at], more)
            np.subtract.at(change, hi[at] + 1, more)
            below = np.r_[np.uint64(0), term.cumsum()]
        return mix((out + change.cumsum()[:-1]) * np.full(n, _BACK, np.uint64).cumprod())

    def windows(self) -> tuple[np.ndarray, Distinct]:
        """Starts of the candidates, and their distinct names with fingerprints of their words."""
        at = self.candidates()
        owner = self.ids[self.levels[0].text[at]]
        if not len(at):
            return at, Distinct(np.zeros(0, np.uint64), owner, np.zeros(0, np.uint32))
        check = (windows(self.levels[0].name, WINDOW)[at] >> np.uint64(64 - CHECK_BITS)).astype(np.uint32)
        return at, Distinct(self.signatures()[at], owner, check)


def chunks(docs: DataFrame) -> DataFrame:
    """Coded texts of 13 words or more of documents with an id, with ids and fingerprints of the texts."""

    def take(batch: pa.RecordBatch, rows: slice, words: Words) -> tuple[np.ndarray, np.ndarray, dict[str, pa.Array]]:
        ids, prints = column(batch, "doc_id", rows), column(batch, "print", rows)
        fits = (words.count >= WINDOW) & ids.is_valid().to_numpy(zero_copy_only=False)
        return words.hash[np.repeat(fits, words.count)], words.count[fits], {"ids": ids.filter(pa.array(fits)), "prints": prints.filter(pa.array(fits))}

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("print"))
    return C.coded(rows, CHUNK_WORDS, take, "ids long, prints long", lower=False)


def _standing(sent: list[bytes], order: np.ndarray, first: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, int]:
    """1 for names that a chunk found in two documents, or that two chunks sent."""
    many = np.concatenate([C.unpack(x, np.uint8) for x in sent])[order]
    stands = (np.maximum.reduceat(many, first) > 0) | (np.diff(np.r_[first, len(many)]) > 1)
    return stands[number].astype(np.uint8), int(stands.sum())


def _smaller(sent: list[bytes], order: np.ndarray, first: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, int]:
    """1 where another chunk has the window, of the same symbols and words, in a document with a smaller id."""
    got = np.concatenate([C.unpack(x, CHECKED) for x in sent])[order]
    least, check = got["least"], got["check"]
    by = np.lexsort((check, number))
    new = np.ones(len(by), bool)
    new[1:] = (number[by][1:] != number[by][:-1]) | (check[by][1:] != check[by][:-1])
    out = np.empty(len(by), np.uint8)
    out[by] = np.minimum.reduceat(least[by], np.flatnonzero(new))[np.cumsum(new) - 1] < least[by]
    return out, int(new.sum())


def names(coded: DataFrame, bits: int) -> tuple[Staged, Staged]:
    """Which names of words and level 1 symbols stand, and which of levels 2 and 3: a Spark round each."""

    def low(row: dict) -> list[tuple]:
        chunk = Chunk(row, LOW[-1])
        return [x for k in LOW for x in chunk.question(k, bits)]

    def high(row: dict, got: pa.Table) -> list[tuple]:
        chunk = Chunk(row)
        chunk.told(LOW, got)
        return [x for k in HIGH for x in chunk.question(k, bits)]

    first = Staged(C.answered(C.ask_all(coded, low), _standing), "names")
    return first, Staged(C.answered(C.ask_with(coded, first.df, high), _standing), "names")


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, print (xxhash64 of the text), spans: the words to remove, as first and next after the last, one after the other."""
    table = Staged(chunks(docs).withColumn("chunk", F.monotonically_increasing_id()), "chunks", n=F.sum("n"))
    coded, bits = table.df, C.bucket_bits(table.seen["n"] or 0)
    first, second = names(coded, bits)
    known = first.df.union(second.df)

    def chunk_of(row: dict, got: pa.Table) -> Chunk:
        chunk = Chunk(row)
        chunk.told(LOW, got)
        chunk.told(HIGH, got)
        return chunk

    def ask(row: dict, got: pa.Table) -> list[tuple]:
        chunk = chunk_of(row, got)
        _, d = chunk.windows()
        values = np.empty(len(d.keys), CHECKED)
        values["least"], values["check"] = d.least, d.check
        return list(d.ask(WINDOWS, chunk.id, bits, values))

    def spans(rows: pa.Table, got: pa.Table) -> pa.Table:
        give_back()
        chunk = chunk_of(rows.to_pylist()[0], got)
        at, d = chunk.windows()
        text = chunk.levels[0].text[at]
        gone = (chunk.ids[text] > d.least[d.which]) | (C.answers_of(got, WINDOWS, len(d.keys), np.uint8)[d.which] > 0)
        at, text = at[gone], text[gone]
        # windows that touch or overlap make one span
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] > at[:-1] + WINDOW) | (text[1:] != text[:-1])
        opens = np.flatnonzero(new)
        begin, end, text = at[opens], at[np.r_[opens[1:], len(at)] - 1] + WINDOW if len(at) else at[opens], text[opens]
        first = (np.cumsum(chunk.count) - chunk.count)[text]
        flat = np.column_stack([begin - first, end - first]).ravel()
        mine, where = np.unique(text, return_index=True)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[2 * where, len(flat)].astype(np.int32)), pa.array(flat.astype(np.int32)))
        return pa.table({"doc_id": pa.array(chunk.ids[mine]), "print": pa.array([chunk.prints[i] for i in mine.tolist()], pa.int64()), "spans": lists})

    asks = C.ask_with(coded, known, ask)
    third = Staged(C.answered(asks, _smaller), "windows")
    found = coded.groupBy("chunk").cogroup(known.union(third.df).groupBy("chunk")).applyInArrow(spans, "doc_id long, print long, spans array<int>")
    out = Staged(found, "repeats")
    for done in (table, first, second, third):
        done.drop()
    return out.df


def keep(text: str | None, spans: list[int] | None) -> tuple[int, list[bytes]]:
    """Number of words of the text, and those outside the spans."""
    words = utf8(text).split()
    if not spans:
        return len(words), words
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out += words[at:a]
        at = b
    return len(words), out + words[at:]


def _with_spans(docs: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, spans) of the rows that lose words, and rows that lose none; only the former, or some more, are shuffled."""
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("print"))
    found = found.dropDuplicates(["doc_id", "print"]).withColumnRenamed("print", "print_")
    maybe = picked(rows, F.col("row.doc_id"), found, "doc_id")
    met = maybe.where("may").join(found, (F.col("row.doc_id") == F.col("doc_id")) & (F.col("print") == F.col("print_")), "left").select("row", "spans")
    return met.where("spans is not null"), maybe.where("not may").select("row").union(met.where("spans is null").select("row"))


def remove(docs: DataFrame) -> DataFrame:
    """The documents without the repeated words: changed texts are their kept words, joined by spaces."""
    cut, whole = _with_spans(docs, repeats(docs))
    row = cut.schema["row"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            ((texts, spans),) = rows_of([batch], "text", "spans")
            new = [b" ".join(keep(t, s)[1]).decode("utf-8", "surrogatepass") for t, s in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("row")), pa.array(new, pa.string())], ["row", "text"])

    changed = cut.select("row", F.col("row.text").alias("text"), "spans").mapInArrow(run, T.StructType([T.StructField("row", row), T.StructField("text", T.StringType())]))
    return whole.select("row.*").union(changed.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]))


def removal_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    cut, whole = _with_spans(docs.select("doc_id", "text"), repeats(docs))
    every = cut.select("row.*", "spans").union(whole.select("row.*", F.lit(None).cast("array<int>")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, spans in rows_of(batches, "doc_id", "text", "spans"):
            out = []
            for t, s in zip(texts, spans, strict=True):
                n, words = keep(t, s)
                out.append((n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return every.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
