"""Language identification with a blended-spectrum string kernel.

k(x, z) counts the n-grams (UTF-8 bytes, lower-case A-Z, lengths 1 to 4) present in both texts,
over the lengths together, normalised by the two sizes. Nystrom landmarks (a bounded set of
labelled texts) span the feature space; kernel ridge regression, one against the rest, gives one
weight vector for each language. A batch of texts is scored by two matrix products: presence
against landmarks, kernel values against weights.

The model is fitted on whole texts of a sample of labelled rows: `fit_rows` in all and `landmarks` of
them, shared equally by the languages, but at least LEAST_ROWS rows and one landmark for each
language, so every labelled language is learned. Every row is scored on its whole text. Sizes are
counted over the n-grams of the landmarks.

Cases: a null text or one without a letter is `und` with score 0; repeated ids give a row each;
null languages teach nothing; without any learned language all rows are `und`; ties go to the
language first in order; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket, rows_of, utf8

FIT_ROWS, LANDMARKS, LONGEST, RIDGE = 1200, 96, 4, 1e-2
#: Rows a language is fitted on at least, if it has them.
LEAST_ROWS = 8
#: n-grams are looked up by the top bits of a hash; the few that share a slot with another one, in a sorted array.
SLOT_BITS = 20
UNKNOWN = "und"

_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "ignore")))


def grams(text: bytes) -> list[np.ndarray]:
    """Codes of the n-grams of lengths 1 to 4: the bytes with the length in front, as one number."""
    b = np.frombuffer(text.lower(), np.uint8).astype(np.uint64)
    out, code = [], np.zeros(len(b), np.uint64)
    for n in range(1, LONGEST + 1):
        if len(b) < n:
            break
        code = (code[: len(b) - n + 1] << np.uint64(8)) | b[n - 1 :]
        out.append(code | np.uint64(n << 40))
    return out


def slot(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)


class Spectrum:
    """The landmarks' n-grams, with a slot table that finds them."""

    def __init__(self, landmarks: list[bytes]):
        sets = [np.unique(np.concatenate(grams(t))) for t in landmarks]
        codes = np.unique(np.concatenate(sets))
        at = slot(codes)
        _, first = np.unique(at, return_index=True)  # one n-gram a slot
        self.rest = np.delete(codes, first)  # sorted
        self.codes = np.concatenate([codes[first], self.rest])
        self.table = np.zeros(1 << SLOT_BITS, np.int32)
        self.table[at[first]] = np.arange(1, len(first) + 1)
        self.shared = np.zeros(1 << SLOT_BITS, bool)
        self.shared[slot(self.rest)] = True
        self.first, self.width = len(first), len(codes)

    def presence(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), self.width + 1), np.float32)
        for i, text in enumerate(texts):
            row = out[i]
            for codes in grams(text):
                at = slot(codes)
                found = self.table[at]
                hit = self.codes[found - 1] == codes
                row[found[hit]] = 1
                if len(self.rest):
                    left = codes[~hit & self.shared[at]]
                    k = np.minimum(np.searchsorted(self.rest, left), len(self.rest) - 1)
                    row[1 + self.first + k[self.rest[k] == left]] = 1
        return out[:, 1:]


def normalised(p: np.ndarray) -> np.ndarray:
    return p / np.sqrt(np.maximum(p.sum(1, keepdims=True), 1))


def fit(texts: list[bytes], langs: list[str], landmarks: int = LANDMARKS) -> dict | None:
    """texts and langs are the bounded sample, in a fixed order."""
    names = sorted(set(langs))
    if not names:
        return None
    marks, per = [], max(1, landmarks // len(names))
    for name in names:
        marks += [t for t, g in zip(texts, langs, strict=True) if g == name][:per]
    space = Spectrum(marks)
    basis = normalised(space.presence(marks))
    values, vectors = np.linalg.eigh((basis @ basis.T).astype(np.float64))
    keep = values > 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])  # K_mm^(-1/2)
    z = np.concatenate([(normalised(space.presence(texts[i : i + 200])) @ basis.T).astype(np.float64) for i in range(0, len(texts), 200)]) @ root
    z = np.column_stack([z, np.ones(len(z))])
    y = np.array([[1.0 if g == n else -1.0 for n in names] for g in langs])
    w = np.linalg.solve(z.T @ z + RIDGE * np.eye(z.shape[1]), z.T @ y)
    return {"names": names, "space": space, "basis": basis, "weights": root @ w[:-1], "bias": w[-1]}


def predict(texts: list[bytes], model: dict | None) -> tuple[list[str], np.ndarray]:
    known = np.array([bool(model) and has_letter(t) for t in texts], bool)
    best, score = np.zeros(len(texts), int), np.zeros(len(texts))
    if known.any():
        kernel = normalised(model["space"].presence([t for t, k in zip(texts, known, strict=True) if k])) @ model["basis"].T
        f = kernel @ model["weights"] + model["bias"]
        best[known] = f.argmax(1)
        e = np.exp(4 * (f - f.max(1, keepdims=True)))
        score[known] = 1 / e.sum(1)
    return [model["names"][b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], score


def sample(docs: DataFrame, fit_rows: int) -> DataFrame:
    """An equal share of labelled rows of each language, chosen by a hash of the id: fit_rows in all, or LEAST_ROWS a language if that is more."""
    rows = docs.where("lang is not null and text is not null").where(bucket(F.col("doc_id"), 4) != 2)
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    share = max(LEAST_ROWS, fit_rows // max(1, len(sizes)))
    chance = F.xxhash64("doc_id").cast("double") / float(2**64) + 0.5
    bounds = docs.sparkSession.createDataFrame([(lang, min(1.0, 1.5 * share / n + 20 / n)) for lang, n in sizes.items()], "lang string, bound double")
    # all rows of a language if its bound is 1: the chance of the largest hashes is rounded up to 1
    picked = rows.join(F.broadcast(bounds), "lang").where((chance < F.col("bound")) | (F.col("bound") >= 1)).select("doc_id", "lang", "text")
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    return picked.withColumn("k", F.row_number().over(first)).where(F.col("k") <= share).orderBy("lang", "k")


def identify(docs: DataFrame, fit_rows: int = FIT_ROWS, landmarks: int = LANDMARKS) -> DataFrame:
    """doc_id, held_out, lang_pred, score; one pass over the texts after the fit."""
    docs = docs.select("doc_id", "text", "lang")
    rows = sample(docs, fit_rows).collect()
    model = fit([utf8(r["text"]) for r in rows], [r["lang"] for r in rows], landmarks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows_of(batches, "doc_id", "text"):
            for i in range(0, len(ids), 250):
                langs, score = predict([utf8(t) for t in texts[i : i + 250]], model)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 250], pa.int64()), pa.array(langs, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(bucket(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
