"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Fixed base rules reject first. Beyond them each rule measures one statistic of the whole text and
rejects above a cutoff. The cutoffs of all rules lie on one fixed path of LEVELS + 1 levels, from the
loosest to the tightest; how far it is followed is learned, per stratum of text length, on labelled
holdouts. A level is admitted only if the number of texts labelled good that any rule rejects there is
so small that the exact binomial tail P(Bin(n, alpha) <= that number) is at most delta / strata.
Levels are tested from the loosest on until the first failure, so testing many of them, and many
rules at once, needs no further correction; strata are corrected by Bonferroni. With probability
1 - delta no stratum loses more than alpha of its good texts to the learned rules. A stratum with too
few labels to certify the loosest level (91 good ones at the defaults) has no learned rule.

Cases: a null, empty or blank text has no words and fails the base rules; documents with equal
ids are measured apart and each gets its row; labels that are null count for nothing, repeated
labels count as often as they stand; an empty table gives no rows; without labels only the base
rules hold; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Staged, bucket, split_words

ALPHA, DELTA = 0.04, 0.05
#: Upper ends of the strata but the last, in words.
STRATA = (300,)
LEVELS = 100
#: rule: statistic, the cutoff at level 0 and that at level LEVELS; a rule rejects what is above.
RULES = {
    "symbols": ("n_symbols / greatest(n_words, 1)", 4.0, 0.0),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", 1.0, 0.0),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", 0.2, 0.0),
    "upper": ("n_upper / greatest(word_chars, 1)", 1.0, 0.0),
    "digits": ("n_digits / greatest(word_chars, 1)", 1.0, 0.0),
    "long_words": ("word_chars / greatest(n_words, 1)", 45.0, 5.0),
}


def measure(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The statistics of every whole text; no shuffle."""
    whole = F.coalesce(F.col(text), F.lit(""))
    first = docs.select(F.col(key), whole.alias("x"), split_words(F.col(text)).alias("w"))
    lines = F.filter(F.split("x", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    second = first.select(
        key,
        F.size("w").cast("long").alias("n_words"),
        F.regexp_replace("x", SPACE, "").alias("solid"),
        lines.alias("lines"),
        F.when(F.size("w") >= 5, F.transform(F.sequence(F.lit(1), F.size("w") - 4), lambda i: F.xxhash64(F.slice("w", i, 5))))
        .otherwise(F.array().cast("array<bigint>"))
        .alias("h"),
    )
    gone = lambda chars: F.char_length("solid") - F.char_length(F.translate("solid", chars, ""))
    third = second.select(
        key,
        "n_words",
        F.char_length("solid").cast("long").alias("word_chars"),
        gone("#*$%&|<>").cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        (F.char_length("solid") - F.char_length(F.regexp_replace("solid", r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        gone("0123456789").cast("long").alias("n_digits"),
        F.when(
            F.size(F.array_distinct("h")) < F.size("h"),
            F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("p")))),
        ).alias("s"),
    )
    # windows found twice: equal neighbours among the sorted ones; then words covered, by their starts
    twice = lambda x, i: F.coalesce(F.get("s", i - 1).h == x.h, F.lit(False)) | F.coalesce(F.get("s", i + 1).h == x.h, F.lit(False))
    fourth = third.withColumn("p", F.array_sort(F.transform(F.filter("s", twice), lambda x: x.p)))
    covered = F.aggregate(
        F.transform("p", lambda x, i: F.least(F.lit(5), F.coalesce(F.get("p", i + 1) - x, F.lit(5)))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    return fourth.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("s", "p")


def base_failed() -> Column:
    return F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")


def stratum() -> Column:
    out = F.lit(len(STRATA))
    for i, end in reversed(list(enumerate(STRATA))):
        out = F.when(F.col("n_words") < end, i).otherwise(out)
    return out.cast("int")


def level(rule: str) -> Column:
    """The first level at which the rule rejects the text; above LEVELS if none does."""
    statistic, loose, tight = RULES[rule]
    return F.greatest(F.floor((F.lit(loose) - F.expr(statistic)) / ((loose - tight) / LEVELS)) + 1, F.lit(0)).cast("int")


def most_rejections(n: int, rate: float, tail: float) -> int:
    """The largest k < n with P(Bin(n, rate) <= k) <= tail, exactly; -1 if there is none."""
    if not n:
        return -1
    i = np.arange(min(n, 64 + int(2 * rate * n)), dtype=float)  # the tail is past it, far above the mean
    steps = np.log((n - i[1:] + 1) / i[1:]) + math.log(rate) - math.log1p(-rate)
    below = np.logaddexp.accumulate(np.cumsum(np.r_[n * math.log1p(-rate), steps]))
    return int(np.searchsorted(below, math.log(tail), side="right")) - 1


def certify(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, n_good, most, level: the last level admitted, null if none is.

    The driver sees a count for each stratum.
    """
    good = measured.join(labels.where("quality = 1").select("doc_id"), "doc_id").where(~base_failed())
    first = F.least(*[level(r) for r in RULES])
    counts = good.select(stratum().alias("stratum"), first.alias("level")).groupBy("stratum", "level").count()
    sizes = {r["stratum"]: r["n"] for r in counts.groupBy("stratum").agg(F.sum("count").alias("n")).collect()}
    limits = [(s, n, most_rejections(n, alpha, delta / (len(STRATA) + 1))) for s, n in sizes.items()]
    table = measured.sparkSession.createDataFrame(limits, "stratum int, n_good long, most int")
    # good texts rejected up to a level are those whose first level it is, or an earlier one
    rejected = counts.withColumn("rejected", F.sum("count").over(Window.partitionBy("stratum").orderBy("level")))
    fails = rejected.join(F.broadcast(table), "stratum").where("rejected > most").groupBy("stratum").agg(F.min("level").alias("fails"))
    last = F.least(F.coalesce(F.col("fails") - 1, F.lit(LEVELS)), F.lit(LEVELS))
    return table.join(fails, "stratum", "left").select("stratum", "n_good", "most", F.when((F.col("most") >= 0) & (last >= 0), last).alias("level"))


def apply_rules(measured: DataFrame, certified: DataFrame) -> DataFrame:
    """Adds base_failed, the names of the rules that reject, and kept."""
    limits = certified.select(F.col("stratum").alias("_stratum"), F.col("level").alias("_level"))
    joined = measured.join(F.broadcast(limits), stratum() == F.col("_stratum"), "left")
    rejects = F.filter(F.array(*[F.when(level(r) <= F.col("_level"), F.lit(r)) for r in RULES]), lambda x: x.isNotNull())
    return joined.select(*measured.columns, base_failed().alias("base_failed"), rejects.alias("rejected_by")).withColumn(
        "kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)
    )


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Statistics, base_failed and kept for every document. The last fold (crc32 mod 4 is 2) never calibrates."""
    measured = Staged(measure(docs), "rules").df
    calibration = labels.where(bucket(F.col("doc_id"), 4) != 2)
    return apply_rules(measured, certify(measured, calibration, alpha, delta))
