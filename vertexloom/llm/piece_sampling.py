"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A text is the public vocabulary's pieces over `▁` for spaces, with one `▁` in front. Its piece
lattice falls apart where a run of spaces or a line break begins, as no piece goes on there, so each
unit (a word with the spaces before it, or a line break) has a lattice of its own. Forward filtering
sums the weights of all segmentations up to each place; backward sampling draws pieces from the end,
each with its exact probability, so a text's segmentation is a sample of p(pieces) ~ product of
weight(piece) ** alpha, weight being 1 / (rank + 1) of the piece: the public model is a byte-pair one,
whose scores are ranks. The draws are hashes of (row key, place in the text), and shares are whole
numbers (of 2 ** 36, at least 1) that depend on the unit alone, so a row has the same segmentation in
any batch, partition or run. Characters without a piece, and the character `▁` itself, are spelled in
byte pieces, which keeps decoding lossless.

Forward tables are made once for each distinct unit and kept within a task while they have at most
MOST_EDGES edges; all units of a batch are sampled together, and a batch holds a bounded number of
bytes (one text may be longer).

Cases: null and empty texts have no pieces and decode to an empty text; very long texts and units
are encoded whole; equal texts under different keys may be cut differently; repeated keys with
equal texts are cut alike; a null key is a key like any other; an empty table gives no rows; further
columns pass, and as with `withColumn` a column named like a new one is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, parts, span_hashes, sums, text_slices

ALPHA = 1.0
#: Bytes of text that are sampled together; a task holds some 300 bytes for each while it makes tables.
BATCH_BYTES = 150_000
#: Edges of forward tables that a task keeps.
MOST_EDGES = 1_000_000
SPACE = "▁"
_MARK, _OWN_MARK = 0x2581, 0x110000  # `▁` for a space, and in the text itself
_ROLL = np.uint64(0x9E3779B97F4A7C15)
#: Shares are counted in units of 2 ** -SHARE_BITS of a node's heaviest edge.
SHARE_BITS = 36


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """Vocabulary: a hash of each piece's code points -> (id, log weight), and byte pieces."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte = np.zeros(256, np.int32)
        found: list[tuple[str, int]] = []
        for i in range(m.get_piece_size()):
            p = m.id_to_piece(i)
            if m.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
            elif not (m.is_control(i) or m.is_unknown(i)) and SPACE not in p.lstrip(SPACE) and " " not in p and "\n" not in p:
                found.append((p, i))
        self.longest = max(len(p) for p, _ in found)
        sizes = np.array([len(p) for p, _ in found])
        at, hashes = np.cumsum(sizes) - sizes, np.zeros(len(found), np.uint64)
        spelled = points("".join(p for p, _ in found))
        for n in range(self.longest):
            longer = np.flatnonzero(sizes > n)
            hashes[longer] = mix(hashes[longer] * _ROLL + spelled[at[longer] + n])
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.ids = np.array([i for _, i in found], np.int32)[order]
        self.weights = (-alpha * np.log(np.arange(len(found)) + 2.0))[order]
        self.floor = -alpha * np.log(len(found) + 2.0)
        self.maybe = np.zeros(1 << 20, bool)  # quick test before the search
        self.maybe[hashes >> np.uint64(44)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h that are pieces, and their rows."""
        at = np.flatnonzero(self.maybe[h >> np.uint64(44)])
        row = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        hit = self.hashes[row] == h[at]
        return at[hit], row[hit]


def spellings(path: str) -> list[bytes]:
    """The bytes that each piece id stands for."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(m.get_piece_size()):
        p = m.id_to_piece(i)
        out.append(bytes([int(p[3:5], 16)]) if m.is_byte(i) else b"" if m.is_control(i) or m.is_unknown(i) else p.replace(SPACE, " ").encode())
    return out


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def unit_spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with one space before each text that isn't empty, where units begin in them, and how many units each text has."""
    size = np.diff(np.r_[0, ends])
    size = size + (size > 0)
    edge = np.r_[0, np.cumsum(size)]
    first = edge[:-1][size > 0]
    own = np.ones(edge[-1], bool)
    own[first] = False
    out = np.full(edge[-1], 32, np.uint8)
    out[own] = data
    space, line = out == 32, out == 10
    begins = line.copy()
    begins[1:] |= (space[1:] & ~space[:-1]) | (line[:-1] & ~space[1:])
    begins[first] = True
    begin = np.flatnonzero(begins)
    return out, begin, np.diff(np.searchsorted(begin, edge))


def spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all spans, one after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Lattices:
    """Forward tables of the distinct units met so far.

    Nodes are the places between a unit's characters; edges are sorted by the node where they end,
    and `below` sums up the shares of a node's edges. Edge pieces below 0 stand for a character that is spelled in
    bytes.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.hashes, self.unit = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted; numbers of the units
        self.last = np.zeros(0, np.int64)  # by unit
        self.opens, self.total, self.start = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)  # by node
        self.below, self.source, self.piece = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)  # by edge

    def find(self, text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Numbers of the units in these spans of the bytes."""
        padded = np.r_[text, np.zeros(8, np.uint8)]
        distinct, index, which = np.unique(span_hashes(padded, begin, size), return_index=True, return_inverse=True)
        if len(self.piece) > MOST_EDGES:
            self.clear()
        at = np.searchsorted(self.hashes, distinct)
        new = np.flatnonzero(np.r_[self.hashes, np.uint64(0)][at] != distinct) if len(self.hashes) else np.arange(len(distinct))
        if len(new):
            number = len(self.last) + np.arange(len(new))
            self.add(text[spans(begin[index[new]], size[index[new]])], size[index[new]])
            self.hashes, self.unit = np.insert(self.hashes, at[new], distinct[new]), np.insert(self.unit, at[new], number)
            at = np.searchsorted(self.hashes, distinct)
        return self.unit[at][which]

    def add(self, text: np.ndarray, n_bytes: np.ndarray) -> None:
        """Makes the tables of units of the given lengths, one after the other in the bytes."""
        pieces = self.pieces
        size = sums(((text & 0xC0) != 0x80).astype(np.int64), n_bytes)
        c = points(text.tobytes().decode("utf-8", "surrogatepass")).copy()
        begin = np.cumsum(size) - size
        unit = np.repeat(np.arange(len(size)), size)
        c[c == _MARK] = _OWN_MARK
        c[c == 32] = _MARK
        left = np.repeat(begin + size, size) - np.arange(len(c))  # characters up to the unit's end
        starts, lengths, ids, weights = [], [], [], []
        h, i = np.zeros(len(c), np.uint64), np.arange(len(c), dtype=np.int32)
        single = np.zeros(len(c), bool)
        for n in range(1, pieces.longest + 1):
            fits = left[i] >= n
            i, h = i[fits], h[fits]
            if not len(i):
                break
            h = mix(h * _ROLL + c[i + n - 1])
            at, row = pieces.find(h)
            starts.append(i[at])
            lengths.append(np.full(len(at), n, np.int32))
            ids.append(pieces.ids[row])
            weights.append(pieces.weights[row])
            if n == 1:
                single[i[at]] = True
        spelled = np.flatnonzero(~single)
        starts.append(spelled)
        lengths.append(np.ones(len(spelled), np.int32))
        ids.append(-1 - c[spelled].astype(np.int32))
        weights.append(np.full(len(spelled), pieces.floor))
        start, length = np.concatenate(starts).astype(np.int64), np.concatenate(lengths)
        source = start + unit[start]  # a unit has one node more than characters
        node, place = source + length, start + length - begin[unit[start]]
        order = np.lexsort((length, node, place))
        source, node, place = source[order], node[order], place[order]
        weight = np.concatenate(weights)[order]
        alpha, total = np.zeros(len(c) + len(size)), np.zeros(len(c) + len(size), np.int64)
        below, opens = np.empty(len(node), np.int64), np.zeros(len(c) + len(size), np.int64)
        rounds = np.searchsorted(place, np.arange(1, int(place[-1]) + 2))
        for a, b in zip(rounds[:-1].tolist(), rounds[1:].tolist(), strict=True):
            ends = node[a:b]
            new = np.ones(b - a, bool)
            new[1:] = ends[1:] != ends[:-1]
            head = np.flatnonzero(new)
            many = np.diff(np.r_[head, b - a])
            v = alpha[source[a:b]] + weight[a:b]
            top = np.maximum.reduceat(v, head)
            run = np.cumsum(np.ldexp(np.exp(v - np.repeat(top, many)), SHARE_BITS).astype(np.int64) + 1)
            before = np.r_[0, run[head[1:] - 1]]
            below[a:b] = run - np.repeat(before, many)
            at = ends[head]
            total[at] = run[head + many - 1] - before
            opens[at] = a + head
            alpha[at] = top + np.log(total[at] * 2.0**-SHARE_BITS)
        first = np.zeros(len(total), bool)
        first[begin + np.arange(len(size))] = True
        nodes, edges = len(self.total), len(self.piece)
        self.last = np.r_[self.last, nodes + begin + size + np.arange(len(size))]
        self.opens, self.total, self.start = np.r_[self.opens, edges + opens], np.r_[self.total, total], np.r_[self.start, first]
        self.below, self.source = np.r_[self.below, below], np.r_[self.source, nodes + source]
        self.piece = np.r_[self.piece, np.concatenate(ids)[order].astype(np.int32)]

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """One of the edges that end at each node, by u from [0, 1)."""
        total = self.total[node]
        r = np.minimum((u * total).astype(np.int64), total - 1)
        e = self.opens[node]
        on = np.flatnonzero(self.below[e] <= r)
        while len(on):
            e[on] += 1
            on = on[self.below[e[on]] <= r[on]]
        return e


def sample_slice(keys: np.ndarray, data: np.ndarray, ends: np.ndarray, table: Lattices) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts, and how many each has. The draw for a piece hashes (key, unit's place in the text, pieces drawn in the unit)."""
    text, begin, sizes = unit_spans(data, ends)
    if not len(begin):
        return np.zeros(0, np.int32), sizes
    number = table.find(text, begin, np.diff(np.r_[begin, len(text)]))
    node = table.last[number]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(node)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    seed = mix(mix(keys.view(np.uint64))[owner] + place.astype(np.uint64))
    live, steps, order, k = np.arange(len(node)), [], [], 0
    while len(live):
        u = (mix(seed[live] + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        e = table.draw(node, u)
        steps.append(table.piece[e])
        order.append(live)
        node = table.source[e]
        more = ~table.start[node]
        live, node = live[more], node[more]
        k += 1
    ids, unit = np.concatenate(steps), np.concatenate(order)
    depth = np.repeat(np.arange(len(order)), [len(o) for o in order])
    count = np.bincount(unit, minlength=len(seed))
    # pieces were drawn from the end of each unit, so draw d of c stands at place c - 1 - d
    out = np.empty(len(ids), np.int64)
    out[(np.cumsum(count) - count)[unit] + count[unit] - 1 - depth] = ids
    out, size = spell(out, table.pieces)
    ends = np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(sums(count, sizes))]]
    return out, np.diff(ends)


def spell(ids: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids below 0 become the byte pieces of their character; and how many pieces each id became."""
    size, at = np.ones(len(ids), np.int64), np.flatnonzero(ids < 0)
    chars, which = np.unique(-1 - ids[at], return_inverse=True)
    spelled = [pieces.byte[np.frombuffer(chr(_MARK if c == _OWN_MARK else c).encode("utf-8", "surrogatepass"), np.uint8)] for c in chars.tolist()]
    size[at] = np.array([len(x) for x in spelled], np.int64)[which] if len(at) else 0
    out = np.repeat(ids, size).astype(np.int32)
    first = np.cumsum(size) - size
    for k in range(4):  # the k-th byte of each
        longer = np.flatnonzero(size[at] > k)
        table = np.array([x[k] if len(x) > k else 0 for x in spelled], np.int32)
        out[first[at[longer]] + k] = table[which[longer]] if len(longer) else 0
    return out, size


class Spellings:
    """The bytes of each piece, one after the other."""

    def __init__(self, path: str):
        raw = spellings(path)
        self.size = np.array([len(x) for x in raw], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)

    def texts(self, ids: np.ndarray, count: np.ndarray) -> pa.Array:
        """The texts that runs of pieces spell, without the space in front."""
        size = self.size[ids]
        out = self.bytes[spans(self.begin[ids], size)]
        n = sums(size, count)
        inner = np.ones(len(out), bool)
        inner[(np.cumsum(n) - n)[n > 0]] = False
        ends = np.cumsum(n - (n > 0))
        texts = pa.LargeStringArray.from_buffers(len(count), pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(out[inner].tobytes()))
        texts.validate(full=True)
        return texts.cast(pa.string())


def hash_key(x: object) -> int:
    return x if isinstance(x, int) else int.from_bytes(hashlib.blake2b(str(x).encode(), digest_size=8).digest(), "big", signed=True)


def encoder(path: str, alpha: float, key: str = "doc_id", text: str = "text", out: str = "pieces") -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    """A function that adds the pieces to a batch; it keeps its tables from call to call."""
    table = Lattices(Pieces(path, alpha))

    def add(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys = np.array([hash_key(x) for x in batch.column(batch.schema.get_field_index(key)).to_pylist()], np.int64)
        for rows, data, ends in text_slices(batch.column(batch.schema.get_field_index(text)), BATCH_BYTES):
            ids, count = sample_slice(keys[rows], data, ends, table)
            pieces = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)].astype(np.int32)), pa.array(ids, pa.int32()))
            yield with_column(batch.slice(rows.start, rows.stop - rows.start), out, pieces)

    return add


def decoder(path: str, pieces: str = "pieces", out: str = "decoded") -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    table = Spellings(path)

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(batch.schema.get_field_index(pieces))
        offsets = column.offsets.to_numpy()
        return with_column(batch, out, table.texts(column.values.to_numpy()[offsets[0] : offsets[-1]], np.diff(offsets)))

    return add


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    """The batch with a new last column; one of the same name, in any case, goes."""
    names = [n for n in batch.schema.names if n.lower() != name.lower()]
    return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), values], [*names, name])


def _schema(df: DataFrame, **new: T.DataType) -> T.StructType:
    gone = {n.lower() for n in new}
    return T.StructType([f for f in df.schema.fields if f.name.lower() not in gone] + [T.StructField(n, t) for n, t in new.items()])


def encode(docs: DataFrame, path: str | None = None, alpha: float = ALPHA, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with `pieces`, an array of piece ids."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add = encoder(path, alpha, key, text)
        for batch in parts(batches):
            yield from add(batch)

    return docs.mapInArrow(run, _schema(docs, pieces=T.ArrayType(T.IntegerType())))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The encoded rows with `decoded`, the text that their pieces spell."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(decoder(path), parts(batches))

    return encoded.mapInArrow(run, _schema(encoded, decoded=T.StringType()))


def encode_and_decode(docs: DataFrame, path: str | None = None, alpha: float = ALPHA) -> DataFrame:
    """The documents with `pieces` and `decoded`, in one pass."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, back = encoder(path, alpha), decoder(path)
        for batch in parts(batches):
            yield from map(back, add(batch))

    return docs.mapInArrow(run, _schema(docs, pieces=T.ArrayType(T.IntegerType()), decoded=T.StringType()))


def round_trip(docs: DataFrame, path: str | None = None, alpha: float = ALPHA) -> DataFrame:
    """doc_id, n_pieces, pieces_sha256, decoded_sha256, lossless: digests of the encoding and of its way back."""
    both = encode_and_decode(docs.select("doc_id", "text"), path, alpha)
    return both.select(
        "doc_id",
        F.size("pieces").cast("long").alias("n_pieces"),
        F.sha2(F.array_join(F.col("pieces").cast("array<string>"), " "), 256).alias("pieces_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"),
    )
