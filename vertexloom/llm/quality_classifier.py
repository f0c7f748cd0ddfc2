"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance of the statistics, shrunk towards the pooled covariance and
towards the pooled variances. Scores are differences of Gaussian log-densities: Mahalanobis
distances with the inverses of the Cholesky factors, computed once and sent to the tasks.
The moments are summed on the executors, so any number of labelled rows may be used; the driver
sees two matrices of fixed size.

Cases: a null or empty text has the statistics of a text without words and is scored like any
other; ids that repeat get a row each; null labels are ignored, repeated labels count as often as
they stand; without labels of both classes every score is the share of good labels (1 if there
are no labels, so that nothing is rejected on no evidence); an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staged, bucket, parts, rows_of, utf8

NAMES = ["words", "word_len", "short", "distinct", "upper", "digit", "symbol", "punct", "pipe", "other", "lines", "line_dup", "triples", "longest"]
SHRINK_POOLED, SHRINK_ROUND, CUT = 0.2, 0.02, 0.7

_CLASS = np.zeros((256, 6), np.float64)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>@=+~^_{}[]\\/", b".,;:!?\"'()-", b"|", bytes(range(32)) + b"\x7f")):
    _CLASS[np.frombuffer(_chars, np.uint8), _i] = 1


def statistics(text: bytes) -> np.ndarray:
    """Transformed statistics of one text; shares are taken to the square root, counts to the logarithm."""
    words = text.split()
    n, counts = len(words), np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = counts @ _CLASS
    solid = max(1, len(text) - int(counts[[32, 9, 10, 11, 12, 13]].sum()))
    lines = [x for x in text.split(b"\n") if x.strip()]
    sizes = np.fromiter(map(len, words), np.int64, n)
    triples = len(set(zip(words, words[1:], words[2:], strict=False)))
    share = np.sqrt(
        [
            (sizes <= 3).mean() if n else 0,
            len(set(words)) / max(1, n) ** 0.75,
            kinds[0] / solid,
            kinds[1] / solid,
            kinds[2] / solid,
            kinds[3] / solid,
            kinds[4] / solid,
            max(0.0, kinds[5] - counts[[9, 10, 11, 12, 13]].sum()) / solid,
            len(lines) / max(1, n),
            1 - len(set(lines)) / max(1, len(lines)),
            1 - triples / max(1, n - 2) if n > 2 else 0,
        ]
    )
    return np.concatenate([[np.log1p(n), np.log1p(sizes.mean() if n else 0)], share, [np.log1p(sizes.max() if n else 0)]])


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, x: array of the statistics; one pass over the texts, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows_of(batches, "doc_id", "text"):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([statistics(utf8(t)) for t in texts], pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


def fit(stats: DataFrame, labels: DataFrame) -> dict:
    """Class moments, summed where the rows are; returns priors, means and Cholesky factors."""
    d = len(NAMES)
    rows = stats.join(labels.where("quality in (0, 1)").select("doc_id", "quality"), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d, 1 + d))
        for xs, ys in rows_of(batches, "x", "quality"):
            x = np.column_stack([np.ones(len(xs)), np.array(xs).reshape(-1, d)])
            y = np.array(ys)
            for k in (0, 1):
                total[k] += x[y == k].T @ x[y == k]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "v"])

    cells = rows.select("x", "quality").mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((2, 1 + d, 1 + d))
    for c in cells:
        total.ravel()[c["cell"]] = c["v"]
    n = total[:, 0, 0]
    if n.min() < 2:
        return {"share": float(n[1] / n.sum()) if n.sum() else 1.0}
    mean = total[:, 0, 1:] / n[:, None]
    cov = total[:, 1:, 1:] / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    pooled = (cov * n[:, None, None]).sum(0) / n.sum()
    spread = np.diag(np.maximum(np.diag(pooled), 1e-6))
    shrunk = [(1 - SHRINK_POOLED - SHRINK_ROUND) * c + SHRINK_POOLED * pooled + SHRINK_ROUND * spread for c in cov]
    factors = [np.linalg.cholesky(c + 1e-8 * np.eye(d)) for c in shrunk]
    inverse = [np.linalg.inv(f) for f in factors]  # of the cached triangular factors
    return {"log_prior": np.log(n / n.sum()), "mean": mean, "inverse": inverse, "log_det": [2 * np.log(np.diag(f)).sum() for f in factors]}


def scores(x: np.ndarray, model: dict) -> np.ndarray:
    if "share" in model:
        return np.full(len(x), model["share"])
    log = [
        model["log_prior"][k] - 0.5 * (model["log_det"][k] + (((x - model["mean"][k]) @ model["inverse"][k].T) ** 2).sum(1)) for k in (0, 1)
    ]
    return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def score(stats: DataFrame, model: dict) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, xs in rows_of(batches, "doc_id", "x"):
            s = scores(np.array(xs, float).reshape(-1, len(NAMES)), model)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(s)], ["doc_id", "score"])

    return stats.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted; learns only from labels outside the held-out fold."""
    stats = Staged(document_statistics(docs), "stats").df
    model = fit(stats, labels.where(bucket(F.col("doc_id"), 4) != 2))
    return score(stats, model).select(
        "doc_id", F.coalesce(bucket(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The documents with a score of at least cut, all columns; the pass that scores also filters."""
    model = fit(document_statistics(docs), labels.where(bucket(F.col("doc_id"), 4) != 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            ((texts,),) = rows_of([batch], "text")
            x = np.array([statistics(utf8(t)) for t in texts]).reshape(-1, len(NAMES))
            yield batch.filter(pa.array(scores(x, model) >= cut))

    return docs.mapInArrow(run, docs.schema)
