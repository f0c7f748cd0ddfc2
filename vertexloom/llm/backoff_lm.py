"""Language-model scoring with a weighted backoff automaton.

Tokens are words in lower case (A-Z) and one end. States are the contexts seen in training: the empty
one, words, and word pairs seen LEAST times. A context h has an arc for each token w seen after it, with probability
p(w | h) = (c(h w) + PRIOR * p(w | h')) / (c(h) + PRIOR), h' being h without its first word (Dirichlet
smoothing); at the empty context p(w) = (c(w) + 1) / (N + V + 1). For all other tokens a failure
arc of weight PRIOR / (c(h) + PRIOR) leads to h'. So the probabilities after each state add up to
one. A text is read left to right: at each token the state is the longest suffix read that is a
context; failure arcs are taken until one has an arc, and log10 weights are added up.

All pairs, and all triples that go on from a state, are in the automaton, however rare, and counts are
exact at any size of the table. The automaton is spread over buckets by the hash of the n-gram and never gathered. Texts
are coded once, in chunks. Each chunk sends its distinct words and pairs with their training counts
to the buckets and gets the total counts back; then the triples that begin with a state. These answers
hold all states, arcs and failure arcs that the chunk's texts can meet; as a state follows from the
two words before, the steps of all texts of a chunk are taken together. Chunks and buckets have bounded sizes; a
frequent n-gram is one entry a chunk.

Cases: null, empty and blank texts have one token, the end; repeated ids are scored row by row; rows
with a null id are training rows; without training rows every token is unknown (N and V are 0); very
long texts are read whole; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as C
from .common import _ROLL, Staged, Words, bucket, column, give_back, mix, sums

#: Weight of the shorter context, in observations; and how often a pair is seen that is a state.
PRIOR, LEAST = 4.0, 2
CHUNK_TOKENS = C.CHUNK_WORDS
#: The hash of the token that ends a text.
END = np.uint64(0x5EED0F7E27A1D00D)


def tokens(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each with its end, and how many each text has."""
    size = words.count + 1
    out = np.full(int(size.sum()), END)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(size) - 1] = False
    out[inner] = words.hash
    return out, size


def chunks(docs: DataFrame) -> DataFrame:
    """Coded texts, with ids, folds and lengths."""

    def take(batch: pa.RecordBatch, rows: slice, words: Words) -> tuple[np.ndarray, np.ndarray, dict[str, pa.Array]]:
        h, size = tokens(words)
        return h, size, {"ids": column(batch, "doc_id", rows), "held": column(batch, "held", rows), "tokens": pa.array(size)}

    return C.coded(docs, CHUNK_TOKENS, take, "ids long, held boolean, tokens long", lower=True)


class Chunk:
    """A chunk's n-grams by length: `keys`, sorted hashes; `at`, the tokens where each ends; `which`, its place in keys for these."""

    def __init__(self, row: dict):
        words, codes, self.sizes = C.code_arrays(row)
        self.id, self.ids, self.held = row["chunk"], row["ids"], np.array(row["held"], bool)
        self.train = np.repeat(~self.held, self.sizes)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.h, self.place = words[codes], place
        self.keys, self.at, self.which = {1: words}, {1: np.arange(len(codes))}, {1: codes}
        self.at[2] = np.flatnonzero(place >= 1)
        self._hash2 = mix(self.h[:-1] * _ROLL + self.h[1:])
        self.keys[2], self.which[2] = np.unique(self._hash2[self.at[2] - 1], return_inverse=True)

    def triples(self, c2: np.ndarray) -> None:
        """Takes up the triples that begin with a state. c2: counts of pairs."""
        pair = np.zeros(len(self.h), np.int64)
        pair[self.at[2]] = c2[self.which[2]]
        ends = np.flatnonzero(self.place >= 2)
        self.at[3] = ends[pair[ends - 1] >= LEAST]
        self.keys[3], self.which[3] = np.unique(mix(self._hash2[self.at[3] - 2] * _ROLL + self.h[self.at[3]]), return_inverse=True)

    def asks(self, k: int, bits: int) -> Iterator[tuple]:
        """(k, bucket, chunk, keys, training counts) of the n-grams of length k."""
        n = np.bincount(self.which[k], self.train[self.at[k]], len(self.keys[k])).astype(np.uint32)
        for b, s in C.slices(self.keys[k], bits):
            yield k, b, self.id, C.pack_sorted(self.keys[k][s]), C.pack(n[s])

    def scores(self, counts: dict[int, np.ndarray], norm: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known tokens, base score and score of each text. counts: by length and key."""
        seen = counts[1][self.which[1]]
        known, context = seen > 0, seen
        p = (seen + 1.0) / norm  # of the arc out of the context so far
        base = np.log10(p)
        score = base.copy()  # from that context on
        for k in (2, 3):
            ends, seen = self.at[k], counts[k][self.which[k]]
            before = context[ends - 1]
            p[ends] = (seen + PRIOR * p[ends]) / (before + PRIOR)
            fail = np.log10(PRIOR / (before + PRIOR))  # 0 where there is no such state
            score[ends] = np.where(seen > 0, np.log10(p[ends]), fail + score[ends])
            context = np.zeros(len(p), np.int64)
            context[ends] = seen
        return tuple(sums(x, self.sizes) for x in (known.astype(np.int64), base, score))


def _totals(sent: list[bytes], order: np.ndarray, first: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, int]:
    total = np.add.reduceat(np.concatenate([C.unpack(x, np.uint32) for x in sent])[order].astype(np.int64), first)
    return total[number], int((total > 0).sum())


def _counts(answers: pa.Table, chunk: Chunk, k: int) -> np.ndarray:
    return C.answers_of(answers, k, len(chunk.keys[k]), np.int64)


def count_short(coded: DataFrame, bits: int) -> DataFrame:
    """Counts of the chunks' words and pairs, with the number of distinct ones seen in training."""

    def ask(row: dict) -> list[tuple]:
        chunk = Chunk(row)
        return [*chunk.asks(1, bits), *chunk.asks(2, bits)]

    return C.answered(C.ask_all(coded, ask), _totals)


def count_triples(coded: DataFrame, short: DataFrame, bits: int) -> DataFrame:
    """Counts of the chunks' triples that begin with a state."""

    def ask(row: dict, answers: pa.Table) -> list[tuple]:
        chunk = Chunk(row)
        chunk.triples(_counts(answers, chunk, 2))
        return list(chunk.asks(3, bits))

    return C.answered(C.ask_with(coded, short.where("k = 2"), ask), _totals)


def score(docs: DataFrame, fold: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document."""
    rows = docs.select("doc_id", "text", F.coalesce(bucket(F.col("doc_id"), fold) == held, F.lit(False)).alias("held"))
    in_training = F.expr("aggregate(zip_with(held, tokens, (h, t) -> if(h, 0L, t)), 0L, (a, t) -> a + t)")
    table = Staged(chunks(rows).withColumn("chunk", F.monotonically_increasing_id()), "chunks", n=F.sum("n"), n_train=F.sum(in_training))
    coded, bits = table.df, C.bucket_bits(table.seen["n"] or 0)
    short = Staged(count_short(coded, bits), "short", words=F.sum(F.when(F.col("k") == 1, F.col("distinct"))))
    triples = Staged(count_triples(coded, short.df, bits), "triples")
    total = table.seen["n_train"] or 0
    norm = total + (short.seen["words"] or 0) + 1.0

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        give_back()
        chunk = Chunk(rows.to_pylist()[0])
        counts = {k: _counts(answers, chunk, k) for k in (1, 2)}
        chunk.triples(counts[2])
        counts[3] = _counts(answers, chunk, 3)
        known, base, s = chunk.scores(counts, norm)
        columns = [pa.array(chunk.ids, pa.int64()), pa.array(chunk.held), pa.array(chunk.sizes), pa.array(known), pa.array(np.full(len(known), total, np.int64)), pa.array(base), pa.array(s)]
        return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    answers = short.df.union(triples.df).groupBy("chunk")
    return coded.groupBy("chunk").cogroup(answers).applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
