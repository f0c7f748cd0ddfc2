"""Importance resampling towards a target: documents drawn by how much likelier their n-grams are in the target.

One scan of a text keeps running zlib states, one for each of the last n words as a start: a new word
extends each state by a space and itself and opens a state of its own, so every run of 1 to n words
costs one zlib call and no string is built. Each state is a feature's CRC; modulo `buckets` it is the
feature's bucket. A text is stored as its distinct buckets and their counts; Spark counts buckets over
all texts of the corpus and of the target, takes the log ratio of the two smoothed counts as a
bucket's gain, and sums gains by document. A Gumbel number hashed from the id is added, and the
highest scores are drawn without replacement, so a run can be repeated. Gains are at most `buckets`
rows and are broadcast up to MOST_BUCKETS, else joined by shuffle.

Ranks come from ranges of scores: only candidates that can be drawn are sorted, range by range, and
what is added up in order is one number a range. Candidates are first cut down to the ranges that the
draw reaches.

Cases: null, empty and wordless texts have no features and weight 0; very long texts are scanned
whole; ties in the score go to the smaller id, a null id last and repeated rows in any order; a null
id is hashed as an empty one; repeated rows count and return as often as they occur; an empty corpus
gives no rows, an empty target the gains of its smoothed counts; only the id and text columns are
read, so further columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Staged, parts

NGRAM, BUCKETS, PERCENT, LEAST_WORDS, SEED = 1, 10_000, 10, 20, 2024
MOST_BUCKETS = 1 << 20
#: Bytes of words: digits, letters and all of other scripts; A-Z count as a-z.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def ring(words: list[bytes], n: int = NGRAM) -> Iterator[int]:
    """The CRCs of all runs of 1 to n consecutive words, joined by one space."""
    states: list[int] = []  # one for each start, the oldest first
    crc = zlib.crc32
    for w in words:
        tail = b" " + w
        states = [crc(tail, s) for s in states[len(states) - n + 1 :]] if len(states) >= n else [crc(tail, s) for s in states]
        states.append(crc(w))
        yield from states


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


def bucket_counts(docs: DataFrame, n: int = NGRAM, buckets: int = BUCKETS, text: str = "text") -> DataFrame:
    """The other columns, with n_words, n_features and `counts`, an array of (bucket, n), of each text."""
    kept = [c for c in docs.columns if c != text]
    schema = ", ".join([f"`{c}` {t}" for c, t in docs.dtypes if c != text] + ["n_words long, n_features long, counts array<struct<bucket:int,n:long>>"])
    item = pa.list_(pa.struct([("bucket", pa.int32()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 500):
            n_words, n_features, offsets, bucket, times = [], [], [0], [], []
            for t in batch.column(batch.schema.get_field_index(text)).to_pylist():
                words = words_of(t)
                found = Counter([x % buckets for x in ring(words, n)])
                n_words.append(len(words))
                n_features.append(sum(found.values()))
                bucket.extend(found.keys())
                times.extend(found.values())
                offsets.append(len(bucket))
            pairs = pa.StructArray.from_arrays([pa.array(bucket, pa.int32()), pa.array(times, pa.int64())], ["bucket", "n"])
            counts = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs, type=item)
            own = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*own, pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), counts], [*kept, "n_words", "n_features", "counts"])

    return docs.mapInArrow(run, schema)


def totals(counted: DataFrame, name: str) -> DataFrame:
    """(bucket, name): features in each bucket."""
    return counted.select(F.inline("counts")).groupBy("bucket").agg(F.sum("n").alias(name))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of the corpus's buckets, as floor(1000 * log ratio)."""
    both = totals(corpus, "s").join(totals(target, "t"), "bucket", "left").withColumn("t", F.coalesce("t", F.lit(0)))
    sums = [c.agg(F.coalesce(F.sum("n_features"), F.lit(0))).first()[0] for c in (corpus, target)]
    s, t = (F.lit(float(x + buckets)) for x in sums)
    plus = lambda c: (F.col(c) + 1).cast("double")
    return both.select("bucket", F.floor(1000 * F.log((plus("t") * s) / (plus("s") * t))).alias("gain"))


def importance_scores(docs: DataFrame, target: DataFrame, n: int = NGRAM, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight, score) of every document; row tells equal ids apart."""
    corpus = Staged(bucket_counts(docs.select("doc_id", "text"), n, buckets).withColumn("row", F.monotonically_increasing_id()), "buckets").df
    aim = Staged(bucket_counts(target.select("text"), n, buckets), "target").df
    gain = gains(corpus, aim, buckets)
    known = F.broadcast(gain) if buckets <= MOST_BUCKETS else gain
    each = corpus.select("row", F.inline("counts")).join(known, "bucket")
    weights = each.groupBy("row").agg(F.sum(F.col("n") * F.col("gain")).alias("weight"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    luck = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    weight = F.coalesce("weight", F.lit(0))
    return corpus.join(weights, "row", "left").select("row", "doc_id", "n_words", "n_features", weight.alias("weight"), (weight + luck).alias("score"))


def draw(scores: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """(row, rank) of the floor(percent * N / 100) highest scores among the N documents with enough words."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    able = scores.where(F.col("n_words") >= least_words).select("row", "doc_id", "score")
    ranged = Staged(able.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges", n=F.count("*")).df
    # as many rows as there are partitions
    sizes = ranged.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all"))
    most = F.floor(F.col("all") * percent / 100)
    reached = ranged.join(F.broadcast(before), "part").where(F.col("before") < most)
    ranked = reached.withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    return ranked.where(F.col("rank") <= most).select("row", F.col("rank").cast("long").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, n: int = NGRAM, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null where it isn't drawn."""
    scores = Staged(importance_scores(docs, target, n, buckets, seed), "scores").df
    return scores.join(draw(scores, percent, least_words), "row", "left").select("doc_id", "n_features", "weight", "score", "rank")
