"""N-gram Jaccard join: a size-aware heavy-light join of documents over word shingles.

Two documents link when the Jaccard similarity of their sets of 5-word shingles is 0.75 or more.
Shingles have one global order: rare ones first, by a table of the frequent ones (each makes up at
least FREQUENT of all shingles, so the table has at most 1 / FREQUENT entries), then by hash. In
that order the first k shingles that two linked sets share lie within the first
|x| - ceil(0.75 |x|) + k shingles of both. So

* light sets (smaller than the boundary) publish all 2-subsets of that prefix for k = 2,
* heavy sets, and the light ones large enough to link with them, publish the prefix for k = 1;
  heavy sets then scan the inverted lists of those shingles.

The boundary minimises the expected number of rows published and scanned, from the histogram of
set sizes and the mean number of rows that a published shingle meets, which is measured on a fixed
share of the shingles.

A pair is only taken up at a key after which both sets have enough shingles left to link; where a
linked pair first meets they have.

Lists are not expanded into pairs. Sets that are equal form one class first, and all that follows
is about classes. Each list then offers links to a few centres; candidates pass a parity bitmap (its
Hamming distance never exceeds the symmetric difference) and an exact comparison, and found links
join components. After that a list offers only pairs from different components, so a group of near
copies costs its length while no link between components is lost.

A text's shingles are hashed where they are needed, from the whole text, rather than kept: the sets
of all documents are larger than their texts. Texts are never shuffled; rows that may be needed are
picked by a bit table of fixed size, and matched exactly by their sets' signatures afterwards.

Cases: null and empty texts have no shingles and link with nothing; a text of fewer than 5 words is
one shingle; equal texts share a class; rows with equal ids are documents of their own, each with
the component of its own text; a null id links with nothing and has a null component; ties are
settled by the smallest id; an empty table gives no rows; further columns are ignored. Very long
texts are handled whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import component_roots
from .common import _ROLL, Staged, Words, column, mix, parts, picked, rows_of, signed, sums, text_words, windows

WORDS, NUM, DEN = 5, 3, 4
#: Share of all shingles from which on one counts as frequent.
FREQUENT = 2e-6
#: Shingles that a task counts at once.
CHUNK = 2_000_000
#: One in so many shingles (by hash) is counted to find out how many rows a published one meets.
SCAN_SAMPLE = 256
#: Rounds in which lists offer links to centres before all pairs across components are tried.
STAR_ROUNDS = 2
#: Centres that a list offers in a round: the set that can share most from the key on, and others by hash.
CENTRES = 6


def shingle_sets(words: Words, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles, one text after the other, and how many each has.

    A text of fewer words is one shingle.
    """
    h, n, first = words.hash, words.count, words.first()
    size = np.where(n >= k, n - k + 1, n > 0)
    flat = np.empty(int(size.sum()), np.uint64)
    if not len(flat):
        return flat, size
    start = np.cumsum(size) - size
    inner = words.place()[: max(0, len(h) - k + 1)] <= np.repeat(n - k, n)[: max(0, len(h) - k + 1)]
    flat[np.repeat(n >= k, size)] = windows(h, k)[inner]
    for m in range(1, k):
        at = np.flatnonzero(n == m)
        v = h[first[at]]
        for j in range(1, m):
            v = mix(v * _ROLL + h[first[at] + j])
        flat[start[at]] = v
    for a, b in zip(start.tolist(), (start + size).tolist(), strict=True):
        flat[a:b].sort()
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    new[start[size > 0]] = True
    return flat[new], sums(new.astype(np.int64), size)


def overlap(n: int) -> int:
    """The least number of shingles that a set of n shares with a linked one."""
    return -(-NUM * n // DEN)


def prefix(n: int, k: int) -> int:
    return min(n, n - overlap(n) + k)


def bitmap(h: np.ndarray) -> bytes:
    """Parities of hash classes; twice as many bits as shingles, a power of two from 64 to 8192."""
    bits = 1 << min(13, max(6, math.ceil(math.log2(2 * max(1, len(h))))))
    odd = np.bincount((mix(h) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def distance(a: bytes, b: bytes) -> int:
    """Hamming distance of two bitmaps; the longer is folded."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def signatures(flat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over each set: with its size, what tells sets apart."""
    return signed(sums(flat, n)), signed(sums(mix(flat + np.uint64(1)), n))


def summaries(docs: DataFrame) -> DataFrame:
    """One row a document (doc_id, n, sig1, sig2, bits) and rows (token, times) of shingles that are frequent in a task's chunk.

    Rows with a null `times` are the shingles of the sample that measures how long lists get.
    """
    names = ["doc_id", "n", "sig1", "sig2", "bits", "token", "times"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> Iterator[pa.RecordBatch]:
            token, times = np.unique(np.concatenate(held), return_counts=True)
            often = times >= max(4, FREQUENT * size)
            n = int(often.sum())
            yield pa.RecordBatch.from_arrays([pa.nulls(n, t) for t in types[:5]] + [pa.array(signed(token[often])), pa.array(times[often])], names)

        for batch in parts(batches):
            for rows, words in text_words(batch, lower=True):
                flat, n = shingle_sets(words)
                ends = np.cumsum(n).tolist()
                bits = [bitmap(flat[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                columns = [column(batch, "doc_id", rows), pa.array(n), *map(pa.array, signatures(flat, n)), pa.array(bits, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns + [pa.nulls(len(n), t) for t in types[5:]], names)
                some = flat % np.uint64(SCAN_SAMPLE) == 0
                if m := int(some.sum()):
                    nulls = [pa.nulls(m, t) for t in types]
                    nulls[2], nulls[5] = pa.array(np.repeat(signatures(flat, n)[0], n)[some]), pa.array(signed(flat[some]))
                    yield pa.RecordBatch.from_arrays(nulls, names)
                held.append(flat)
                size += len(flat)
                if size >= CHUNK:
                    yield from counted()
                    held, size = [], 0
        if held:
            yield from counted()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, sig1 long, sig2 long, bits binary, token long, times long")


def frequent_table(summary: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles and how often they were counted, sorted by hash; at most 1 / FREQUENT entries."""
    rows = summary.where("times is not null").groupBy("token").agg(F.sum("times").alias("times")).where(F.col("times") >= FREQUENT * total)
    t = rows.toArrow()
    token = t.column("token").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], t.column("times").to_numpy().astype(np.int64)[order]


def rows_met(summary: DataFrame) -> float:
    """Sets that a shingle of a set meets in its list, on average over the sampled shingles that aren't frequent."""
    lists = summary.where("token is not null and times is null").select("token", "sig1").distinct().groupBy("token").agg(F.count("*").alias("c"))
    often = summary.where("times is not null").select("token").distinct()
    r = lists.join(often, "token", "left_anti").agg(F.sum(F.col("c") * F.col("c")).alias("met"), F.sum("c").alias("all")).first()
    return r["met"] / r["all"] if r["all"] else 1.0


def choose_boundary(histogram: dict[int, int], scan: float) -> int:
    """The set size from which on inverted lists are expected to cost fewer rows than 2-subsets.

    histogram: number of sets by size; scan: rows of a list met by each shingle published.
    """
    def cost(boundary: int) -> float:
        total = 0.0
        for n, count in histogram.items():
            p1, p2 = prefix(n, 1), prefix(n, 2)
            total += count * p2 * (p2 - 1) / 2 if n < boundary else count * p1 * (1 + scan)
            if n < boundary and DEN * n >= NUM * boundary:
                total += count * p1  # published for heavy sets to meet
        return total

    return min((2**i for i in range(1, 9)), key=cost)


def postings(docs: DataFrame, often: tuple[np.ndarray, np.ndarray], boundary: int) -> DataFrame:
    """(key, sig1, n, left, hot): what each set publishes; left: the most it can share from there on, what it shares there included.

    A task publishes equal sets that follow within a slice of rows once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(often)

    def published(flat: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each set its keys, what is left after them, and which are hot."""
        token, times = shared.value
        weight = np.zeros(len(flat), np.int64)
        if len(token):
            at = np.minimum(np.searchsorted(token, flat), len(token) - 1)
            weight = np.where(token[at] == flat, times[at], 0)
        ends = np.cumsum(n).tolist()
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            h, w, size = flat[a:b], weight[a:b], b - a
            k2 = prefix(size, 2)
            # sets are sorted by hash, so a stable sort by weight leaves ties in that order
            first = np.argsort(w, kind="stable")[:k2] if w.any() else np.arange(k2)
            keys, left, hot = [], [], []
            if DEN * size >= NUM * boundary:
                p1 = first[: prefix(size, 1)]
                keys.append(h[p1])
                left.append(size - np.arange(len(p1)))
                hot.append(w[p1] > 0)
            if size < boundary:
                i, j = np.triu_indices(len(first), 1)
                keys.append(mix(h[first[i]] * _ROLL + h[first[j]]) ^ np.uint64(1))
                left.append(size - j + 1)
                hot.append((w[first[i]] > 0) & (w[first[j]] > 0))
            yield np.concatenate(keys), np.concatenate(left), np.concatenate(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            for rows, words in text_words(batch, lower=True):
                flat, n = shingle_sets(words)
                sig1, _ = signatures(flat, n)
                _, one = np.unique(sig1, return_index=True)
                one = one[(n[one] > 2) & column(batch, "doc_id", rows).is_valid().to_numpy(zero_copy_only=False)[one]] if len(one) else one
                # sets of one or two shingles link with equal sets only
                takes = np.zeros(len(n), bool)
                takes[one] = True
                if not takes.any():
                    continue
                flat, sig1, n = flat[np.repeat(takes, n)], sig1[takes], n[takes]
                keys, left, hot = zip(*published(flat, n), strict=True)
                many = [len(k) for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(np.concatenate(keys))), pa.array(np.repeat(sig1, many)), pa.array(np.repeat(n, many).astype(np.int32)), pa.array(np.concatenate(left).astype(np.int32)), pa.array(np.concatenate(hot))],
                    ["key", "sig1", "n", "left", "hot"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "key long, sig1 long, n int, left int, hot boolean")


def pass_bitmaps(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Drops pairs (a, b) whose bitmaps show too large a difference; exact pairs always pass."""
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, na, nb, xa, xb in rows_of(batches, "a", "b", "na", "nb", "xa", "xb"):
            ok = [distance(p, q) * (DEN + NUM) <= (DEN - NUM) * (m + n) for m, n, p, q in zip(na, nb, xa, xb, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, k in zip(v, ok, strict=True) if k], pa.int64()) for v in (a, b)], ["a", "b"])

    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, h: the sorted shingle hashes of the wanted classes (node, n, sig1, sig2, least).

    A row's set is made where the row is, if its id may be a wanted one; only sets move.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            for _, words in text_words(batch, lower=True):
                flat, n = shingle_sets(words)
                ends = np.cumsum(n).tolist()
                h = [flat[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(n), *map(pa.array, signatures(flat, n)), pa.array(h, pa.binary())], ["n", "sig1", "sig2", "h"])

    rows = picked(docs.select("doc_id", "text"), F.col("doc_id"), wanted, "least").where("may").select("text")
    sets = rows.mapInArrow(run, "n long, sig1 long, sig2 long, h binary")
    return sets.join(wanted.select("node", "n", "sig1", "sig2"), ["n", "sig1", "sig2"]).dropDuplicates(["node"]).select("node", "h")


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with a similarity of 0.75 or more, compared set by set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, ha, hb in rows_of(batches, "a", "b", "ha", "hb"):
            ok = []
            for p, q in zip(ha, hb, strict=True):
                x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(DEN * both >= NUM * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, k in zip(v, ok, strict=True) if k], pa.int64()) for v in (a, b)], ["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("h").alias("ha"))
    right = sets.select(F.col("node").alias("b"), F.col("h").alias("hb"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")


class _Components:
    """Components so far, as (id, root) of the classes that aren't their own component."""

    def __init__(self):
        self.table = None

    def label(self, df: DataFrame, column: str, out: str) -> DataFrame:
        if self.table is None:
            return df.withColumn(out, F.col(column))
        t = self.table.select(F.col("id").alias(column), F.col("root"))
        return df.join(t, column, "left").withColumn(out, F.coalesce("root", column)).drop("root")

    def add(self, found: DataFrame) -> None:
        links = found.select(F.col("a").alias("src"), F.col("b").alias("dst"))
        if self.table is not None:
            links = links.union(self.table.select("id", "root"))
        self.table = component_roots(links)


def verify(docs: DataFrame, candidates: DataFrame, classes: DataFrame, comps: _Components) -> None:
    """Joins components along those candidates that are links; each class first tries one of them."""
    both = candidates.select(F.col("a").alias("node")).union(candidates.select("b")).distinct()
    wanted = Staged(classes.drop("bits").join(both, "node", "left_semi"), "wanted")
    sets = Staged(sets_of(docs, wanted.df), "sets")
    held, rest = [wanted, sets], candidates
    for turn in (1, 2):
        across = comps.label(comps.label(rest, "a", "ca"), "b", "cb").where("ca != cb").select("a", "b")
        held.append(Staged(across, "rest", n=F.count("*")))
        rest = held[-1].df
        if not held[-1].seen["n"]:
            break
        pick = rest if turn == 2 else rest.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        found = Staged(linked(pick, sets.df), "found", n=F.count("*"))
        rest = rest.join(pick, ["a", "b"], "left_anti")
        if found.seen["n"]:
            comps.add(found.df)
        found.drop()
    for table in held:
        table.drop()


def _round(docs: DataFrame, lists: DataFrame, classes: DataFrame, comps: _Components, turn: int) -> None:
    """Pairs from lists that still hold several components: with centres, in the last round all across components."""
    labelled = Staged(comps.label(lists, "node", "comp"), "labelled")
    open_keys = labelled.df.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size"), _first_centre(turn).alias("c")).where("low != high")
    last = turn == STAR_ROUNDS
    columns = ["key", "node", "n", "left", "comp"] + ([] if last else ["size", "c"])
    mine = Staged(labelled.df.join(open_keys.select("key", *columns[5:]), "key").select(*columns), "mine")
    labelled.drop()
    if not last:
        # short lists have one centre; the others of long ones are looked for among long lists only
        long = mine.df.where(F.col("size") > CENTRES).drop("c")
        more = long.groupBy("key").agg(F.array_distinct(F.array(*_centres(turn))).alias("centres"))
        met = mine.df.union(long.join(more, "key").select(*columns[:-1], F.explode("centres").alias("c")))
        met = met.where("comp != c.comp").where(_within("left", "c.left", "n", "c.n"))
        pairs = met.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b"))
    else:
        other = mine.df.toDF("key", "node_b", "n_b", "left_b", "comp_b")
        met = mine.df.join(other, "key").where("comp < comp_b").where(_within("left", "left_b", "n", "n_b"))
        pairs = met.select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b"))
    candidates = Staged(pass_bitmaps(pairs.distinct(), classes), "candidates", n=F.count("*"))
    if candidates.seen["n"]:
        verify(docs, candidates.df, classes, comps)
    candidates.drop()
    mine.drop()


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest id with the same set), component_id for every document."""
    return _components(docs).drop("sig1", "sig2", "comp")


def _components(docs: DataFrame) -> DataFrame:
    summary = Staged(summaries(docs), "summary")
    each = summary.df.where("n is not null").select("doc_id", "n", "sig1", "sig2", "bits")
    alike = each.where("n > 0 and doc_id is not null").groupBy("n", "sig1", "sig2").agg(F.min("doc_id").alias("least"), F.any_value("bits").alias("bits"))
    # numbered once, as the table is written
    classes = Staged(alike.withColumn("node", F.monotonically_increasing_id()), "classes").df
    # sizes to 64 one by one, larger ones in steps of powers of two
    step = F.when(F.col("n") <= 64, F.col("n")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("n"))).cast("long"))
    sizes = classes.where("n > 2").groupBy(step.alias("b")).agg(F.count("*").alias("c"), F.sum("n").alias("s")).collect()
    comps = _Components()
    if sizes:
        often = frequent_table(summary.df, sum(r["s"] for r in sizes))
        boundary = choose_boundary({r["b"]: r["c"] for r in sizes}, rows_met(summary.df))
        lists = Staged(_lists(docs, classes, often, boundary), "lists")
        for turn in range(STAR_ROUNDS + 1):
            _round(docs, lists.df, classes, comps, turn)
        lists.drop()
    roots = comps.label(classes.select("n", "sig1", "sig2", "least", "node"), "node", "comp")
    named = roots.join(roots.groupBy("comp").agg(F.min("least").alias("component_id")), "comp")
    known = F.col("doc_id").isNotNull()
    out = each.drop("bits").join(named.drop("node"), ["n", "sig1", "sig2"], "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(known, F.coalesce("least", "doc_id")).alias("class_id"),
        F.when(known, F.coalesce("component_id", "doc_id")).alias("component_id"),
        "sig1",
        "sig2",
        "comp",
    )


_ONE = ("node", "n", "left", "comp")


def _first_centre(turn: int) -> Column:
    return F.max_by(F.struct(*_ONE), F.struct("left", F.xxhash64("node", F.lit(turn))))


def _centres(turn: int) -> list[Column]:
    return [F.min_by(F.struct(*_ONE), F.xxhash64("node", F.lit(turn * CENTRES + j))) for j in range(1, CENTRES)]


def _within(left_a: str, left_b: str, n_a: str, n_b: str) -> Column:
    """Whether a pair that first meets at a key can still share enough; a linked pair can, where it first meets."""
    return F.expr(f"{DEN + NUM} * least({left_a}, {left_b}) >= {NUM} * ({n_a} + {n_b})")


def _lists(docs: DataFrame, classes: DataFrame, often: tuple, boundary: int) -> DataFrame:
    """(key, node, n, left): published keys that two sets or more share, with the classes.

    Frequent keys are shared anyway, so they are dealt out by set; other keys have a bounded share of
    the rows and are counted where they meet. Sets are told apart by size and one sum here; two that
    agree in both get each other's rows, which the exact comparison sorts out.
    """
    rows = postings(docs, often, boundary).withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("sig1"), F.lit(4096))).otherwise(0))
    here = Window.partitionBy("key", "salt")
    shared = rows.withColumn("low", F.min("sig1").over(here)).withColumn("high", F.max("sig1").over(here)).where("hot or low != high")
    return shared.select("key", "sig1", "n", "left").distinct().join(classes.select("sig1", F.col("n").cast("int").alias("n"), "node"), ["sig1", "n"]).select("key", "node", "n", "left")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component: of those with the smallest id one, the smallest set first. Rows without an id or a shingle stay.

    A row whose id stands once goes or stays by its id. Rows with repeated ids are told apart by their sets.
    """
    found = Staged(_components(docs).where("doc_id is not null and n_shingles > 0"), "found").df
    first = F.min(F.struct("doc_id", F.col("n_shingles").alias("n"), "sig1", "sig2")).alias("k")
    keeps = found.where("doc_id = component_id").groupBy("comp").agg(first).select("k.*")
    by_id = found.groupBy("doc_id").agg((F.count("*") > 1).alias("many"), F.min("component_id").alias("root"))
    touched = Staged(by_id.where("many or root != doc_id").select(F.col("doc_id").alias("id"), "many"), "touched").df
    rows = docs.select(F.struct("*").alias("row"))
    maybe = picked(rows, F.col("row.doc_id"), touched, "id")
    met = maybe.where("may").join(touched, F.col("row.doc_id") == F.col("id"), "left")
    alone = maybe.where("not may").select("row").union(met.where("id is null").select("row"))
    names = ["row", "n", "sig1", "sig2"]

    def signed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            for rows_, words in text_words(batch, lower=True):
                flat, n = shingle_sets(words)
                yield pa.RecordBatch.from_arrays([column(batch, "row", rows_), pa.array(n), *map(pa.array, signatures(flat, n))], names)

    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), *[T.StructField(n, T.LongType()) for n in names[1:]]])
    repeated = met.where("many").select("row", F.col("row.text").alias("text")).mapInArrow(signed_rows, schema)
    one = repeated.where("n > 0").join(keeps.withColumnRenamed("doc_id", "id"), (F.col("row.doc_id") == F.col("id")) & (repeated.n == keeps.n) & (repeated.sig1 == keeps.sig1) & (repeated.sig2 == keeps.sig2), "left_semi")
    one = one.withColumn("id", F.col("row.doc_id")).dropDuplicates(["id", "n", "sig1", "sig2"])
    return alone.union(one.select("row")).union(repeated.where("n = 0").select("row")).select("row.*")
