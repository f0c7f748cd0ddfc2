"""Alignment of two tokenisations of one text, byte by byte.

A is a byte-level BPE over space + text, B a SentencePiece BPE over text, which adds the space. Arrow
tasks tokenise the distinct units of some texts, put them one after the other and emit the ids of both
sides and the places where their tokens end, each told by how many tokens of either side have ended up to it; links and their sums
are Spark higher-order functions, joins and aggregations. The places that `array_intersect` finds in both are cuts;
`zip_with` over them gives the groups, by a `sequence` of tokens where a group has several on
a side, and the last tokens of a group are its link; a text's groups are those of its units in order, put
together by `transform` and summed up by `aggregate`. Only the texts that digests need are joined by Arrow's kernels in the
task that tokenises, at the places that both sides' byte offsets have there: a text a group is dear in loops. Loops read arrays that are bound by a loop around
them (`let`), as a row's columns cost more to read than a group to make. Links of all texts are
counted by pair of ids with partial sums, and the counts go back to the links by a broadcast of the
distinct pairs up to MOST_PAIRS, else by a join. Tasks hold the sums of some HELD_CHUNKS chunks,
however many there are.

Tokenising keeps a table of units. Neither tokeniser joins what lies before and behind a run of
spaces or a line break that follows a solid character (A's pattern begins anew there; no piece of B
goes on across one, which is checked when the vocabulary is read), so a unit's tokens are the same in
each text. Scripts without spaces and odd white space stay inside units. Units are compared as
texts; those of up to KEEP_BYTES characters are kept, as long as all of them have MOST_KEPT tokens at most.

Cases: a text that is null, empty or whose tokens don't spell space + text byte by byte (B reads
U+2581 as a space) has no tokens, groups or links, and its digest is ''; special tokens' strings are
plain text; very long texts and units are tokenised whole; repeated rows count and return as often
as they occur; a null id is an id like any other; an empty table gives no rows; further columns pass
through `tokenize` and `aligned_documents`, and one named like a new column is replaced.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Staged, Wide, parts, sums
from .piece_sampling import model_path, spans, spellings

MOST_PAIRS = 500_000
KEEP_BYTES, MOST_KEPT = 256, 1_000_000
#: Rows that are taken at once, and bytes of text whose units are aligned together (one text may be longer).
ROWS = 200
CHUNK_BYTES = 2_000_000
#: Units that are tokenised by one call, and chunks whose sums a task holds at once.
TOGETHER, HELD_CHUNKS = 10_000, 6
#: A unit begins at a space after a solid character: printable ASCII, or Latin to N'Ko, where there is no other white space.
_UNITS = re.compile(r"(?<=[!-~À-߿])(?= )")
#: As Arrow's kernels read them. A unit that ends in a solid character; where a text can't be cut at every space and line break:
#: one of them stands first or follows no solid character, or none ends the text.
_CLOSED = r"[!-~À-߿]\z"
_OPEN = r"\A[ \n]|[^!-~À-߿](?:[ \n]|\z)"
#: Characters outside alphabets that all versions of Unicode agree on.
_NEWER = re.compile(r"[^\x00-\u024F\u2010-\u2027]")
#: Fixed value: how a byte-level text falls apart before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones stand for themselves, all others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


class Vocabulary:
    """A tokeniser of texts, and the bytes of each of its tokens. units: it goes on across neither a run of spaces nor a line break that follows a solid character."""

    def __init__(self, encode: Callable[[str], list[int]], spelled: list[bytes], units: bool = True):
        self.encode, self.units = encode, units
        self.size = np.array([len(x) for x in spelled], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)

    def spell(self, ids: np.ndarray) -> bytes:
        return self.bytes[spans(self.begin[ids], self.size[ids])].tobytes()


def byte_level(path: str) -> Vocabulary:
    """Texts of the alphabets that have stood in Unicode from the start go through a faster encoder of the same vocabulary, where its merges are in the order of their ids."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    letters = byte_letters()
    special = t.get_added_tokens_decoder()
    spelled = [x.content.encode() if (x := special.get(i)) else bytes(map(letters.__getitem__, t.id_to_token(i) or "")) for i in range(t.get_vocab_size())]
    slow = lambda text: t.encode(text, add_special_tokens=False).ids
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in json.loads(t.to_str())["model"]["merges"]]
    made = [t.token_to_id(a + b) for a, b in merges]
    if made != list(range(256, 256 + len(made))):
        return Vocabulary(slow, spelled)
    ranks = {x: i for i, x in enumerate(spelled) if i not in special}
    fast = tiktoken.Encoding("units", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return Vocabulary(lambda text: slow(text) if _NEWER.search(text) else fast(text), spelled)


def pieces(path: str) -> Vocabulary:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    # a unit stands behind a letter of its own, as in a text, so that no space is added or lost
    ahead = len(m.encode("a"))
    units = not any("▁" in p.lstrip("▁") or "\n" in p for p in map(m.id_to_piece, range(m.get_piece_size())))
    return Vocabulary(lambda text: m.encode("a" + text)[ahead:], spellings(path), units)


def listed(texts: pa.Array) -> list[str]:
    """Python's texts, without the scalars that `to_pylist` makes first."""
    return texts.to_numpy(zero_copy_only=False).tolist()


class Units:
    """Tokens of the units met so far in two vocabularies; `good`: both spell the unit."""

    def __init__(self, sides: tuple[Vocabulary, Vocabulary]):
        self.sides, self.units = sides, all(s.units for s in sides)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}  # of a unit without the space in front, or with it where the text isn't cut at every space
        self.good, self.ids, self.count = array("b"), (array("i"), array("i")), (array("q"), array("q"))

    def cut(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """Keys of the units of all texts, and how many each has. One that follows no solid character is no key of its own: such texts are cut at fewer places."""
        texts = texts.cast(pa.string()).fill_null("")
        some = pc.not_equal(texts, "")
        plain = pc.and_(some, pc.invert(pc.match_substring_regex(texts, _OPEN))) if self.units else pa.array(np.zeros(len(texts), bool))
        at_spaces = pc.split_pattern(pc.replace_substring(texts.filter(plain), "\n", " \n"), " ")
        others = [_UNITS.split(" " + t) if self.units else [" " + t] for t in texts.filter(pc.and_not(some, plain)).to_pylist()]
        keys = pa.concat_arrays([at_spaces.flatten(), pa.array(chain.from_iterable(others), pa.string())]).dictionary_encode()
        each, is_plain = np.zeros(len(texts), np.int64), plain.to_numpy(zero_copy_only=False)
        rows = np.r_[np.flatnonzero(is_plain), np.flatnonzero(some.to_numpy(zero_copy_only=False) & ~is_plain)]
        each[rows] = np.r_[at_spaces.value_lengths().to_numpy(), np.fromiter(map(len, others), np.int64, len(others))]
        begin = np.zeros(len(texts), np.int64)
        begin[rows] = np.cumsum(each[rows]) - each[rows]
        return keys.take(pa.array(spans(begin, each))), each

    def add(self, keys: pa.Array) -> None:
        """Takes new units, those that end in a solid character together, as nothing goes on across their borders."""
        whole = pc.match_substring_regex(keys, r"\A[ \n]")
        units = pc.binary_join_element_wise(pc.if_else(whole, "", " "), keys, "")
        closed = pc.and_not(pc.match_substring_regex(units, _CLOSED), pc.match_substring(units, "▁"))
        closed = closed if self.units else pa.array(np.zeros(len(keys), bool))
        for which, step in ((closed, TOGETHER), (pc.invert(closed), 1)):
            some = units.filter(which)
            self.number.update(zip(listed(keys.filter(which)), range(len(self.good), len(self.good) + len(some)), strict=True))
            for at in range(0, len(some), step):
                self._add(some.slice(at, step))

    def _add(self, units: pa.Array) -> None:
        text, size = "".join(listed(units)), pc.binary_length(units).to_numpy().astype(np.int64)
        spelled = text.encode()
        ids = [np.array(side.encode(text), np.int32) for side in self.sides]
        good = all(side.spell(x) == spelled for side, x in zip(self.sides, ids, strict=True))
        self.good.extend([good] * len(units))
        if not good and len(units) > 1:
            raise ValueError("units that end in solid characters must spell themselves")
        for side, x, kept, count in zip(self.sides, ids, self.ids, self.count, strict=True):
            at = np.r_[0, np.searchsorted(np.cumsum(side.size[x]), np.cumsum(size), side="right")] if good else np.array([0, len(x)])
            kept.frombytes(x.tobytes())
            count.frombytes(np.diff(at).astype(np.int64).tobytes())

    def take(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the units of all texts, and how many each has; none where a unit isn't spelled."""
        cut, each = self.cut(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        keys = listed(cut.dictionary)
        number = np.fromiter(map(self.number.get, keys, repeat(-1)), np.int64, len(keys))
        at = np.flatnonzero(number < 0)
        new = cut.dictionary.take(pa.array(at))
        self.add(new.take(pc.sort_indices(new)))  # like units lie together, which packs better
        number[at] = [self.number[keys[i]] for i in at.tolist()]
        unit = number[cut.indices.to_numpy()]
        for key in new.filter(pc.greater(pc.utf8_length(new), KEEP_BYTES)).to_pylist():
            del self.number[key]
        bad = sums((~np.array(self.good, bool)[unit]).astype(np.int64), each) > 0
        return unit[np.repeat(~bad, each)], np.where(bad, 0, each)

    def tokens(self, side: int, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of these units, one unit after the other, the bytes where they end, and how many each unit has."""
        n = np.array(self.count[side], np.int64)
        ids = np.array(self.ids[side], np.int32)[spans((np.cumsum(n) - n)[unit], n[unit])]
        return ids, np.cumsum(self.sides[side].size[ids]), n[unit]


def joined(texts: pa.Array, stops: np.ndarray, by: str) -> pa.Array:
    """Runs of the texts that stop at these places, each as one text."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, stops].astype(np.int32)), texts), by)


def group_digests(a_ids: np.ndarray, b_ids: np.ndarray, at: np.ndarray, place: np.ndarray, each: np.ndarray) -> pa.Array:
    """Digests of documents' groups as `a1,a2|b1;a3|b2`. at: ends that tokens of both sides have; place: the documents' units, in order; each: how many a document has."""
    ids = [joined(pa.array(x).cast(pa.string()), stops, ",") for x, stops in ((a_ids, at >> 32), (b_ids, (at & (1 << 32) - 1) >> 1))]
    units = joined(pc.binary_join_element_wise(*ids, "|"), np.flatnonzero(at & 1) + 1, ";")
    whole = joined(units.take(pa.array(place)), np.cumsum(each), ";")
    return pa.array([hashlib.sha256(text.as_buffer()).hexdigest() if n else "" for text, n in zip(whole, each.tolist(), strict=True)], pa.string())


_KEPT: dict[tuple[str, str], Units] = {}


def kept_units(a_path: str, b_path: str) -> Units:
    """The units that this worker process knows already; a table that has grown too large begins anew."""
    units = _KEPT.setdefault((a_path, b_path), None) or Units((byte_level(a_path), pieces(b_path)))
    if max(map(len, units.ids)) > MOST_KEPT:
        units.clear()
    _KEPT[a_path, b_path] = units
    return units


def tokenize(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, text: str = "text", digests: bool = False) -> DataFrame:
    """Rows of about CHUNK_BYTES of texts: ids and ends of both tokenisations of their distinct units, one after the other, and the unit of each
    token of A; how often each unit occurs; and `docs`, the documents (without the text) with n_a, n_b and `units`, places among them. An end is how many tokens of A (from bit 32 on) and
    B (from bit 1 on) have ended up to the byte where the token ends, and whether a unit ends there (bit 0): ends are equal where the bytes are. digests: `docs` have groups_sha256 too."""
    a_path, b_path = a_path or model_path("byte_bpe_50k.json"), b_path or model_path()
    ints = lambda kind=T.IntegerType(): T.ArrayType(kind, containsNull=False)
    fields = [f for f in docs.schema.fields if f.name.lower() not in (text.lower(), "n_a", "n_b", "units")]
    own = T.StructType([*fields, T.StructField("n_a", T.LongType()), T.StructField("n_b", T.LongType()), *[T.StructField("groups_sha256", T.StringType())] * digests, T.StructField("units", ints())])
    schema = T.StructType([T.StructField(n, ints(), False) for n in ("a_ids", "a_unit", "b_ids")])
    for n in ("a_ends", "b_ends", "times"):
        schema.add(n, ints(T.LongType()), False)
    schema.add("docs", T.ArrayType(own, containsNull=False), False)
    row = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x, type=pa.list_(pa.field("element", x.type, nullable=False)))
    one = lambda x, kind=np.int32: row(pa.array(x.astype(kind)))

    def chunk(units: Units, batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        unit, each = units.take(rows.column(rows.schema.get_field_index(text)))
        met = np.bincount(unit, minlength=1)
        distinct, place = np.flatnonzero(met), (np.cumsum(met > 0) - 1)[unit]
        (a_ids, a_ends, n_a), (b_ids, b_ends, n_b) = units.tokens(0, distinct), units.tokens(1, distinct)
        unit_ends = np.r_[0, a_ends][np.cumsum(n_a)]
        values = [rows.column(rows.schema.get_field_index(f.name)) for f in fields] + [pa.array(sums(n[place], each)) for n in (n_a, n_b)]
        a_at, b_at = np.bincount(a_ends, minlength=1), np.bincount(b_ends, minlength=1)
        upto = np.cumsum(a_at) << 32 | np.cumsum(b_at) << 1
        upto[unit_ends] |= 1
        if digests:
            values.append(group_digests(a_ids, b_ids, upto[(a_at > 0) & (b_at > 0)], place, each))
        places = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(each)].astype(np.int32)), pa.array(place.astype(np.int32)), type=pa.list_(pa.field("element", pa.int32(), nullable=False)))
        held = pa.StructArray.from_arrays([*values, places], [f.name for f in own.fields])
        lists = [one(x) for x in (a_ids, np.repeat(np.arange(len(distinct)), n_a), b_ids)] + [one(x, np.int64) for x in (upto[a_ends], upto[b_ends], met[distinct])]
        return pa.RecordBatch.from_arrays([*lists, row(held)], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in parts(batches, ROWS):
            held.append(batch)
            size += batch.column(batch.schema.get_field_index(text)).nbytes
            if size >= CHUNK_BYTES:
                yield chunk(kept_units(a_path, b_path), held)
                held, size = [], 0
        if held:
            yield chunk(kept_units(a_path, b_path), held)

    return docs.mapInArrow(run, schema)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is worked out once, however often and in whatever loops body has it."""
    return F.transform(F.array(value), body)[0]


def lets(names: list[str], body: Callable[..., Column]) -> Column:
    """body(columns of these names), as values of their own: a loop gets at these faster than at a row's columns."""
    return body() if not names else let(F.col(names[0]), lambda value: lets(names[1:], lambda *more: body(value, *more)))


def cut_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks with `at`, the ends that tokens of both sides have."""
    # it is used more than once, so it has a projection of its own, which Spark compiles
    return chunks.select("a_ids", "b_ids", "a_unit", "times", "docs", F.array_intersect("a_ends", "b_ends").alias("at"))


def a_upto(at: Column) -> Column:
    return F.shiftright(at, 32).cast("int")


def b_upto(at: Column) -> Column:
    return F.shiftright(at.bitwiseAND(F.lit((1 << 32) - 1)), 1).cast("int")


def ends_unit(at: Column) -> Column:
    return at.bitwiseAND(F.lit(1)) == 1


def by_group(body: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """body(ids of A, of B, what `at` has before a group, what it has at its end) for each group of a cut chunk."""

    def groups(a: Column, b: Column, at: Column) -> Column:
        return F.zip_with(F.slice(F.concat(F.array(F.lit(0).cast("long")), at), F.lit(1), F.size(at)), at, lambda before, here: body(a, b, before, here))

    return lets(["a_ids", "b_ids", "at"], groups)


def group_ids(a: Column, b: Column, before: Column, here: Column) -> Column:
    """(a, b): the ids of a group."""
    ids = lambda of, upto: F.transform(F.sequence(upto(before), upto(here) - 1), lambda i: F.get(of, i))
    return F.struct(ids(a, a_upto).alias("a"), ids(b, b_upto).alias("b"))


def group_link(a: Column, b: Column, _: Column, here: Column) -> Column:
    """The two ids that end a group, as one number."""
    return F.shiftleft(F.get(a, a_upto(here) - 1).cast("long"), 32) + F.get(b, b_upto(here) - 1)


def group_units() -> Column:
    """The place of each group's unit."""
    return lets(["a_unit"], lambda unit: F.transform("at", lambda here: F.get(unit, a_upto(here) - 1)))


def by_unit(values: Column) -> Column:
    """What of the groups' values belongs to each unit of a cut chunk."""
    stops = F.filter(F.transform("at", lambda at, k: F.when(ends_unit(at), k + 1)), lambda k: k.isNotNull())
    low = lambda at, k: F.when(k == 0, 0).otherwise(F.get(at, k - 1))
    return let(values, lambda v: let(stops, lambda at: F.transform(at, lambda stop, k: F.slice(v, low(at, k) + 1, stop - low(at, k)))))


def aligned_documents(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """The documents, without the text, with n_a, n_b and `groups`: (a, b), arrays of ids between two cuts. The last ids of a group are its link."""
    found = cut_chunks(tokenize(docs, a_path, b_path))
    names = [f.name for f in found.schema["docs"].dataType.elementType.fields if f.name not in ("units", "groups")]
    whole = lambda parts_: F.transform("docs", lambda d: F.struct(*[d[n].alias(n) for n in names], F.flatten(F.transform(d["units"], lambda u: F.get(parts_, u))).alias("groups")))
    return found.select(F.inline(let(by_unit(by_group(group_ids)), whole)))


def pair_counts(links: DataFrame) -> DataFrame:
    """(link, n, best): how often each pair of ids is linked in all rows, and whether no other a is linked more often with this b. links: (link, times)."""
    counts = links.groupBy("link").agg(F.sum("times").alias("n"))
    b = F.col("link").bitwiseAND(F.lit((1 << 32) - 1))
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(b)))  # at most one row an id of A


def alignment_digests(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links (a group has one), n_best, count_sum, groups_sha256."""
    found = cut_chunks(tokenize(docs.select("doc_id", "text"), a_path, b_path, digests=True))
    # a row is a chunk, some MB
    held = Wide(found.select(F.monotonically_increasing_id().alias("chunk"), "docs", by_group(group_link).alias("link"), group_units().alias("unit"), "times"), "aligned", chunks=F.count("*"))
    linked = lambda chunks: chunks.select("chunk", "times", F.inline(F.arrays_zip("link", "unit")))
    pairs = Staged(pair_counts(linked(held.df).select("link", F.get("times", F.col("unit")).alias("times"))), "pairs", pairs=F.count("*"))
    few = pairs.seen["pairs"] <= most_pairs
    known = F.broadcast(pairs.df) if few else pairs.df
    # whole chunks are moved once; with a broadcast, all that follows stays where its chunk is. Tasks become more with the chunks, not larger
    tasks = max(held.seen["chunks"] // HELD_CHUNKS, 1)
    linked = linked(held.df.select("chunk", "link", "unit", "times").repartition(tasks, "chunk") if few else held.df).drop("times")
    by_units = linked.join(known, "link").groupBy("chunk", "unit").agg(F.sum(F.when(F.col("best"), (1 << 32) + 1).otherwise(1 << 32)).alias("groups"), F.sum("n").alias("n"))
    # `groups` holds how many there are (from bit 32 on) and how many are the best. As many rows to a chunk as it has units
    by_chunk = (by_units if few else by_units.repartition(tasks, "chunk")).groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("unit", "groups", "n"))).alias("of"))
    total = lambda d, of: F.aggregate(d["units"], F.lit(0).cast("long"), lambda n, u: n + F.get(of, u))
    sums_ = lambda groups, n: F.transform("docs", lambda d: F.struct(*[d[x].alias(x) for x in ("doc_id", "n_a", "n_b")], total(d, groups).alias("groups"), total(d, n).alias("count_sum"), d["groups_sha256"].alias("groups_sha256")))
    each = held.df.select("chunk", "docs").join(by_chunk, "chunk", "left").select("docs", "of.groups", "of.n")
    n_groups, n_best = F.shiftright("groups", 32), F.col("groups").bitwiseAND(F.lit((1 << 32) - 1))
    return each.select(F.inline(lets(["groups", "n"], sums_))).select("doc_id", "n_a", "n_b", n_groups.alias("n_groups"), n_groups.alias("n_links"), n_best.alias("n_best"), "count_sum", "groups_sha256")
