"""The corpus pipeline: five of the operators in a row, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a frame; the runner writes it as Parquet to
the shared folder and hands the written table to the next stage. All stages but the last return
the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm.common import Staged, table
from vertexloom.llm.decontaminate import remove_contaminated
from vertexloom.llm.ngram_jaccard_join import keep_one
from vertexloom.llm.piece_sampling import encode_and_decode
from vertexloom.llm.quality_classifier import keep_good
from vertexloom.llm.substring_dedup import remove


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of the documents given."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that shingle links connect."""
    return keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated 13-word windows; a document that loses all of them stays, empty."""
    return remove(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_pieces, pieces and whether they decode to the text they came from."""
    back = encode_and_decode(docs.select("doc_id", "lang", "source", "text"))
    lossless = F.col("decoded") == F.coalesce("text", F.lit(""))
    return back.select("doc_id", "lang", "source", F.size("pieces").cast("long").alias("n_pieces"), "pieces", lossless.alias("lossless"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substrings),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece encoding", pieces),
]

#: Learned scores, components and sampled pieces are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        now = Staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            before.drop()
        docs, before = now.df, now
    return STAGES[-1][1](spark, docs, sf_dir)
