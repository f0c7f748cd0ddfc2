"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Words lose outer punctuation and case; numbers, names (capitalised words within a sentence) and
units (after a number) become typed placeholders. Windows of 8 template tokens of every document
are hash-joined with those of the benchmark; an item with fewer tokens is one window of its own
length, and documents have windows of each such length too. A window of placeholders alone says too
little, so it is matched by its values. Windows that match along one alignment of a document with an
item are one copy: it counts if it has at least 3 of them (or all of the item's, if it has fewer)
and its slots agree, that is, equal values of the item stand for equal values of the document and
the other way round. So a question with other numbers, names or units is caught, and a chance run of
placeholders is not. As capitals come and go, an item has its windows with names as placeholders and
with names as words, and its first word is taken in each way that a text before it can make it.

Texts become templates by patterns over the whole text, and only hashes of windows meet the
benchmark; the words of a document are looked at again only where windows matched. The benchmark's
windows are broadcast only while they number at most BROADCAST_WINDOWS; beyond it the windows that a
bit table of fixed size lets through are shuffled.

Cases: null, empty and blank texts, and those of punctuation alone, match nothing; repeated ids are
taken as one document, repeated items as one each; null ids match nothing and stay; an item that
stands twice in a document is found on each alignment; of ties none is preferred, all items found
are returned; very long texts are handled whole; empty tables give no rows; further columns are
ignored by `matches` and kept by `remove_contaminated`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Staged, picked

SIZE, LEAST_WINDOWS = 8, 3
BROADCAST_WINDOWS = 200_000

# What is stripped from words, what a number looks like, and the names of units.
STRIP = r"[.,;:!?\"'()\[\]{}]"
NUMBER = r"[$€£]?[+-]?[0-9][0-9.,:/%]*"
UNITS = "mm cm m km g kg mg t l ml s sec min h hr hrs hour hours minute minutes second seconds day days week weeks month months year years meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches yard yards gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres gallon gallons dollar dollars euro euros cent cents percent degrees celsius fahrenheit mph kmh watt watts volt volts".split()

_STARTS, _ENDS = "(?<![^ ])", "(?![^ ])"
_NUMBER = rf"(?=[.,;:!?\"'()\[\]{{}}$€£+0-9-]){_STARTS}{STRIP}*{NUMBER}{STRIP}*{_ENDS}"
_MEASURE = rf"{_NUMBER} {STRIP}*(?i:{'|'.join(sorted(UNITS, key=len, reverse=True))}){STRIP}*{_ENDS}"
#: A capitalised word, with up to 20 marks before it, after a word that doesn't end a sentence.
_NAME = rf"(?=\p{{Lu}})(?<=[^ .!?:] {STRIP}{{0,20}})\p{{Lu}}\p{{Ll}}+(?={STRIP}*{_ENDS})"
_OUTER = rf"{STRIP}+{_ENDS}|{_STARTS}{STRIP}+"
_SLOT = "<(?:number|name|unit)>"


def spaced(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def plain(text: Column) -> Column:
    """The words without outer punctuation, in lower case, between spaces."""
    return F.lower(F.regexp_replace(text, _OUTER, ""))


def template(text: Column, names: bool = True) -> Column:
    """The same with placeholders; it has as many words."""
    named = F.regexp_replace(text, _NAME, "<name>") if names else text
    return plain(F.regexp_replace(F.regexp_replace(named, _MEASURE, "<number> <unit>"), _NUMBER, "<number>"))


def words(spaced_text: Column) -> Column:
    return F.filter(F.split(spaced_text, " "), lambda w: w != "")


def is_slot(word: Column) -> Column:
    return word.isin("<number>", "<name>", "<unit>")


def formed(rows: DataFrame, key: str, text: Column, names: bool = True, least: int = SIZE) -> DataFrame:
    """(key, t, v): words of the template, and the words themselves where `least` slots follow one another."""
    forms = rows.select(key, spaced(text).alias("text")).select(key, "text", template(F.col("text"), names).alias("form"))
    run = rf"(?:{_SLOT} +){{{least - 1}}}{_SLOT}"
    return forms.select(key, words(F.col("form")).alias("t"), F.when(F.col("form").rlike(run), words(plain(F.col("text")))).alias("v"))


def windows(size: Column) -> Column:
    """Hash of each window of `size` words, in order, of columns t and v."""
    places = F.sequence(F.lit(1), F.size("t") - size + 1)
    by_form = lambda i: F.xxhash64(size, F.slice("t", i, size))
    by_value = lambda i: F.when(F.forall(F.slice("t", i, size), is_slot), F.xxhash64(-size, F.slice("v", i, size))).otherwise(by_form(i))
    return F.when(F.size("t") < size, F.array().cast("array<bigint>")).when(F.col("v").isNull(), F.transform(places, by_form)).otherwise(F.transform(places, by_value))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, item_pos, size, h, item_windows): every window that a copy of the item may show."""
    out, size = [], F.least(F.size("t"), F.lit(SIZE))
    for names in (True, False):
        for before in ("", "x ", "1 "):  # at the start, in a sentence, after a number; the word before is cut off again
            led = formed(benchmark.where("item_id is not null"), "item_id", F.concat(F.lit(before), F.coalesce("text", F.lit(""))), names, 1)
            cut = lambda c: F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(1))) if before else F.col(c)  # noqa: E731, B023
            whole = led.select("item_id", cut("t").alias("t"), cut("v").alias("v")).where(F.size("t") > 0)
            every = whole.select("item_id", size.alias("size"), F.posexplode(windows(size)).alias("item_pos", "h"), (F.size("t") - size + 1).alias("item_windows"))
            out.append(every.where("item_pos = 0") if before else every)
    return reduce(DataFrame.union, out).distinct()


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, n_copies): items that a document holds, and their matching windows."""
    items = item_windows(benchmark)
    lengths = {r["size"]: r["n"] for r in items.groupBy("size").agg(F.count("*").alias("n")).collect()}  # SIZE rows at most
    few = sum(lengths.values()) <= BROADCAST_WINDOWS
    known = docs.where("doc_id is not null")
    forms = formed(known, "doc_id", F.col("text"), least=min(lengths, default=SIZE))
    if set(lengths) <= {SIZE}:
        met = forms.select("doc_id", F.posexplode(windows(F.lit(SIZE))).alias("pos", "h"))
    else:  # a window's hash tells its length, too
        placed = F.concat(*[F.transform(windows(F.lit(n)), lambda h, i: F.struct(i.alias("pos"), h.alias("h"))) for n in sorted(lengths)])
        met = forms.select("doc_id", F.explode(placed).alias("x")).select("doc_id", "x.*")
    if not few:
        met = picked(met, F.col("h"), items, "h").where("may").drop("may")
    shift = (F.col("pos") - F.col("item_pos")).alias("shift")
    copies = met.join(F.broadcast(items) if few else items, "h").groupBy("doc_id", "item_id", "size", shift, "item_windows").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    # written, as it is needed twice and costs a pass over all texts
    copies = Staged(copies.where(F.size("at") >= F.least(F.lit(LEAST_WINDOWS), "item_windows")), "copies").df
    # what stands in the slots, of documents and items that met
    found = picked(known.select("doc_id", "text"), F.col("doc_id"), copies, "doc_id").where("may")
    text = found.select("doc_id", spaced(F.col("text")).alias("text"))
    theirs = text.select("doc_id", words(template(F.col("text"))).alias("t"), words(plain(F.col("text"))).alias("v"))
    ours = benchmark.select("item_id", words(plain(spaced(F.col("text")))).alias("item_v"))
    joined = copies.join(theirs, "doc_id").join(F.broadcast(ours) if few else ours, "item_id")
    inside = F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + F.col("size") - 1))))
    filled = F.filter(inside, lambda j: is_slot(F.get("t", j)))
    pairs = F.array_distinct(F.transform(filled, lambda j: F.struct(F.get("v", j).alias("d"), F.get("item_v", j - F.col("shift")).alias("i"))))
    paired = joined.select("doc_id", "item_id", F.size("at").alias("n"), "shift", pairs.alias("pairs"))
    agree = (F.size(F.array_distinct("pairs.d")) == F.size("pairs")) & (F.size(F.array_distinct("pairs.i")) == F.size("pairs"))
    one = paired.where(agree).groupBy("doc_id", "item_id", "shift").agg(F.max("n").alias("n"))  # equal ids or items meet more than once
    return one.groupBy("doc_id", "item_id").agg(F.sum("n").cast("long").alias("n_windows"), F.count("*").alias("n_copies"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item."""
    return docs.join(matches(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
