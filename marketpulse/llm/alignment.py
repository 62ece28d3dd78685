"""Two vocabularies aligned over a corpus, with counts of linked id pairs under a minimal perfect hash.

A is a byte-level vocabulary applied to a space and the text, B one of pieces that puts the
space there itself. Tokens of both are byte ranges of the same string. Where a token of A and
one of B both end, a group ends; two tokens whose ranges overlap are a link. The union of all
ends cuts the string into one segment per link, so links are found without comparing pairs.

1. The ids of every document are written. A first pass aligns them and writes the distinct
   pairs of each task with their counts.
2. The distinct pairs of the corpus are hashed minimally and perfectly, bucket by bucket, in
   levels of bits: a pair keeps the first level in which it meets no other, and its number is
   the count of bits set before it. Pairs stand in a table in that order, so each lookup is
   verified against the pair itself.
3. Each task adds its counts into a dense vector indexed by the hash, cut into chunks; vectors are
   summed in a tree of FAN inputs a node, one shuffle a level, until one vector is left.
4. A second pass aligns the documents again and looks up the count of every link.

Hash, pairs and vector go to every task, so they are bounded: where there are more than
SLICE_PAIRS distinct pairs, ids of B are dealt to slices, each slice takes steps 2 to 4 by itself,
and the documents' sums over slices are added. A pair's competitors for the best count of its id
of B are in its own slice, and one id of B has at most as many pairs as A has ids.

Defined results: a text that is null, empty or whose tokens' bytes aren't a space and the text has no
tokens: zeros and an empty string. Equal rows count as often as they occur. No rows give no
rows. Other columns don't count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialized
from .tokens import mixed
from .vocabularies import byte_vocabulary, id_type, packed, piece_vocabulary, runs_of

SLICE_PAIRS = 1 << 22
#: Pairs hashed by one task at a time, on average; bits a pair at each level.
BUCKET_PAIRS = 1 << 14
SPREAD = 2
CHUNK = 1 << 16
FAN = 8
#: Pairs that a task holds before it counts them together.
HELD_PAIRS = 1 << 20

ENCODED = "row long, doc_id long, a binary, b binary"
RESULT = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per vocabulary the byte length of each id, and its decimal digits with their count in the last column."""

    def digits(n: int) -> np.ndarray:
        width = len(str(n - 1))
        text = np.char.ljust(np.arange(n).astype(f"S{width}"), width).view(np.uint8).reshape(n, width)
        return np.concatenate((text, np.zeros((n, 1), np.uint8), np.char.str_len(np.arange(n).astype("S"))[:, None].astype(np.uint8)), axis=1)

    a, b = byte_vocabulary().names, piece_vocabulary().names
    return np.array([*map(len, a)]), np.array([*map(len, b)]), digits(len(a)), digits(len(b))


def encoded(docs: DataFrame) -> DataFrame:
    """The ids of every row in both vocabularies, packed; none where their bytes aren't the text's."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        byte, piece = byte_vocabulary(), piece_vocabulary()

        def both(text: str | None) -> tuple[bytes, bytes]:
            if not text:
                return b"", b""
            a, b = byte.encode(" " + text, special=False), piece.encode(text)
            want = b" " + text.encode()
            if b"".join([byte.names[i] for i in a.tolist()]) != want or b"".join([piece.names[i] for i in b.tolist()]) != want:
                return b"", b""
            return packed(a, len(byte.names)), packed(b, len(piece.names))

        for batch in batches:
            for part in runs_of(batch, 2):
                ids = [both(t.as_py()) for t in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(x, pa.binary()) for x in zip(*ids))], ["row", "doc_id", "a", "b"])

    plain = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(encode, ENCODED)


class Aligned:
    """The links and groups of several documents at once; arrays run over all of them."""

    def __init__(self, a: list[bytes], b: list[bytes]) -> None:
        size_a, size_b, self.digits_a, self.digits_b = _tables()
        self.first_a, self.a = _joined(a, id_type(len(size_a)))
        self.first_b, self.b = _joined(b, id_type(len(size_b)))
        self.end_a, self.end_b = np.cumsum(size_a[self.a]), np.cumsum(size_b[self.b])
        total = int(self.end_a[-1]) if len(self.a) else 0
        in_a, in_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        in_a[self.end_a], in_b[self.end_b] = True, True
        self.ends, self.common = np.flatnonzero(in_a | in_b), np.flatnonzero(in_a & in_b)
        # Where each document's string ends among all of them.
        self.stop = np.concatenate(([0], self.end_a))[self.first_a]

    def pairs(self) -> np.ndarray:
        """The id pair of every link, the id of B in the upper half."""
        return self.b[np.searchsorted(self.end_b, self.ends)] << 32 | self.a[np.searchsorted(self.end_a, self.ends)]

    def per_document(self, ends: np.ndarray) -> np.ndarray:
        """How many of the ends lie in each document."""
        return np.diff(np.searchsorted(ends, self.stop, "right"))

    def group_texts(self) -> Iterator[bytes]:
        """Each document's groups as decimal ids; empty without tokens."""
        before = np.concatenate(([0], self.common))
        group_a, group_b = np.searchsorted(self.common, self.end_a), np.searchsorted(self.common, self.end_b)
        at_a = np.arange(len(self.a)) + np.searchsorted(self.end_b, before[group_a], "right")
        at_b = np.arange(len(self.b)) + np.searchsorted(self.end_a, before[group_b + 1], "right")
        width = max(self.digits_a.shape[1], self.digits_b.shape[1]) - 1
        n = len(self.a) + len(self.b)
        text, size = np.zeros((n, width), np.uint8), np.empty(n, np.int64)
        for at, ids, digits, group, inside, after in ((at_a, self.a, self.digits_a, group_a, b",", b"|"), (at_b, self.b, self.digits_b, group_b, b",", b";")):
            found = digits[ids]
            size[at] = found[:, -1]
            text[at, : digits.shape[1] - 1] = found[:, :-1]
            last = np.append(group[1:] != group[:-1], True) if len(group) else np.empty(0, bool)
            text[at, found[:, -1]] = np.where(last, after[0], inside[0])
        flat = text[np.arange(width) <= size[:, None]].tobytes()
        cut = np.concatenate(([0], np.cumsum(size + 1)))[self.first_a + self.first_b]
        for low, high in zip(cut[:-1], cut[1:]):
            yield flat[low : high - 1] if high > low else b""


def _joined(ids: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of several documents in one array, and where each begins (and the end)."""
    first = np.concatenate(([0], np.cumsum([len(x) // np.dtype(kind).itemsize for x in ids], dtype=np.int64)))
    return first, np.frombuffer(b"".join(ids), kind).astype(np.int64)


def _pair_counts(rows: DataFrame) -> DataFrame:
    """part, pair, times: the distinct pairs of each task, with their links."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        known, times = np.empty(0, np.int64), np.empty(0, np.int64)

        def merged() -> tuple[np.ndarray, np.ndarray]:
            fresh, n = np.unique(np.concatenate([*held, np.empty(0, np.int64)]), return_counts=True)
            held.clear()
            both, at = np.unique(np.concatenate((known, fresh)), return_inverse=True)
            sums = np.zeros(len(both), np.int64)
            np.add.at(sums, at, np.concatenate((times, n)))
            return both, sums

        for batch in batches:
            for piece in runs_of(batch, 0, 1):
                held.append(Aligned(piece.column(0).to_pylist(), piece.column(1).to_pylist()).pairs())
                if sum(map(len, held)) >= HELD_PAIRS:
                    known, times = merged()
                    if len(known) >= HELD_PAIRS:  # more distinct pairs than a task should hold
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(known), part)), pa.array(known), pa.array(times)], ["part", "pair", "times"])
                        known, times = np.empty(0, np.int64), np.empty(0, np.int64)
        known, times = merged()
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(known), part)), pa.array(known), pa.array(times)], ["part", "pair", "times"])

    return rows.select("a", "b").mapInArrow(count, "part long, pair long, times long")


def _place(key: np.ndarray, level: int, bits: int | np.ndarray) -> np.ndarray:
    salt = mixed(np.array([(level + 3) * 0x9E3779B97F4A7C15 & (1 << 64) - 1], np.uint64))
    return (mixed(key.astype(np.uint64) ^ salt) % np.asarray(bits, np.uint64)).astype(np.int64)


def hash_levels(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Levels of bits that hash distinct `keys` minimally and perfectly, and the keys in the order of their numbers."""
    levels, placed = [], []
    while len(keys):
        bits = SPREAD * len(keys)
        at = _place(keys, len(levels), bits)
        alone = np.bincount(at, minlength=bits) == 1
        kept = alone[at]
        placed.append(keys[kept][np.argsort(at[kept])])
        levels.append(alone)
        keys = keys[~kept]
    return levels, np.concatenate([*placed, np.empty(0, np.int64)])


class PairHash:
    """The number of every known pair: buckets of levels of bits, laid end to end, and the pairs themselves."""

    def __init__(self, buckets: list[tuple[int, list[int], bytes, bytes]], n_buckets: int) -> None:
        """`buckets`: number, bits of each level, all bits packed, keys in order; missing buckets have no keys."""
        self.n_buckets = n_buckets
        depth = max((len(b[1]) for b in buckets), default=0)
        self.bits = np.zeros((depth, n_buckets), np.int64)
        self.base = np.zeros((depth, n_buckets), np.int64)
        packed, keys, at = [], [], 0
        for number, sizes, bits, own in buckets:
            for level, size in enumerate(sizes):
                self.bits[level, number], self.base[level, number] = size, at
                at += size
            packed.append(np.unpackbits(np.frombuffer(bits, np.uint8), count=sum(sizes)))
            keys.append(np.frombuffer(own, "<i8"))
        self.set = np.concatenate([*packed, np.empty(0, np.uint8)]).astype(bool)
        self.keys = np.concatenate([*keys, np.empty(0, np.int64)])
        self.rank = np.cumsum(self.set, dtype=np.int32) - 1

    def numbers(self, pairs: np.ndarray) -> np.ndarray:
        """The number of each pair; a pair that isn't in the table is an error."""
        out = np.full(len(pairs), -1, np.int64)
        rest, bucket = np.arange(len(pairs)), _place(pairs, -2, self.n_buckets)
        for level in range(len(self.bits)):
            bits = self.bits[level, bucket[rest]]
            rest, bits = rest[bits > 0], bits[bits > 0]
            at = self.base[level, bucket[rest]] + _place(pairs[rest], level, bits)
            found = self.set[at]
            out[rest[found]] = self.rank[at[found]]
            rest = rest[~found]
        if len(rest) or (out < 0).any() or not np.array_equal(self.keys[out], pairs):
            raise ValueError("a pair isn't the one that its hash stands for")
        return out


def hashed(pairs: DataFrame, n: int) -> PairHash:
    """The hash of the distinct `pairs`, built bucket by bucket; `n` is about their number."""
    n_buckets = max(1, -(-n // BUCKET_PAIRS))

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _place(batch.column(0).to_numpy(), -2, n_buckets)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(0)], ["bucket", "pair"])

    def build(group: pa.Table) -> pa.Table:
        levels, keys = hash_levels(np.sort(group.column("pair").to_numpy()))
        bits = np.packbits(np.concatenate([*levels, np.empty(0, bool)])).tobytes()
        return pa.table({"bucket": group.column("bucket")[:1], "sizes": pa.array([[len(x) for x in levels]], pa.list_(pa.int64())), "bits": pa.array([bits]), "keys": pa.array([keys.astype("<i8").tobytes()])})

    dealt = pairs.mapInArrow(bucket, "bucket long, pair long")
    built = materialized(dealt.groupBy("bucket").applyInArrow(build, "bucket long, sizes array<long>, bits binary, keys binary"), "hash")
    return PairHash([tuple(r) for r in built.orderBy("bucket").collect()], n_buckets)  # at most SLICE_PAIRS pairs and an id's


def summed(counts: DataFrame, known: PairHash) -> np.ndarray:
    """The count of every pair, by its number: a dense vector per task, summed in a tree."""
    shared = counts.sparkSession.sparkContext.broadcast(known)

    def vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        dense = np.zeros(-(-max(len(table.keys), 1) // CHUNK) * CHUNK, np.int64)
        for batch in batches:
            np.add.at(dense, table.numbers(batch.column(0).to_numpy()), batch.column(1).to_numpy())
        node = TaskContext.get().partitionId()
        for chunk, part in enumerate(dense.reshape(-1, CHUNK)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([chunk]), pa.array([part.astype("<i8").tobytes()])], ["node", "chunk", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.int64)
        for part in group.column("counts"):
            total += np.frombuffer(part.as_py(), "<i8")
        return pa.table({"node": group.column("node")[:1], "chunk": group.column("chunk")[:1], "counts": pa.array([total.astype("<i8").tobytes()])})

    schema = "node long, chunk long, counts binary"
    level = materialized(counts.select("pair", "times").mapInArrow(vector, schema), "vectors")
    widest = level.agg(F.max("node")).first()[0] or 0
    while widest:
        parents = level.withColumn("node", F.expr(f"node div {FAN}"))
        level = materialized(parents.groupBy("node", "chunk").applyInArrow(add, schema), "vectors")
        widest //= FAN
    dense = np.zeros((-(-len(known.keys) // CHUNK), CHUNK), np.int64)
    for _, chunk, part in level.collect():  # one vector of at most SLICE_PAIRS numbers and an id's
        dense[chunk] = np.frombuffer(part, "<i8")
    return dense.ravel()[: len(known.keys)]


def _looked_up(rows: DataFrame, known: PairHash, counts: np.ndarray, wanted: Callable[[np.ndarray], np.ndarray], with_groups: bool) -> DataFrame:
    """The documents aligned again, with the counts of the links whose pair is `wanted`."""
    best = np.zeros(int((known.keys >> 32).max(initial=0)) + 1, np.int64)
    np.maximum.at(best, known.keys >> 32, counts)
    shared = rows.sparkSession.sparkContext.broadcast((known, counts, counts == best[known.keys >> 32]))
    fields = [f.split()[0] for f in RESULT.split(", ")]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, count, is_best = shared.value
        for batch in batches:
            for part in runs_of(batch, 2, 3):
                x = Aligned(part.column(2).to_pylist(), part.column(3).to_pylist())
                pairs = x.pairs()
                mine = np.flatnonzero(wanted(pairs))
                number = table.numbers(pairs[mine])
                sums = np.zeros((2, len(pairs) + 1), np.int64)
                sums[0, mine + 1], sums[1, mine + 1] = is_best[number], count[number]
                cut = np.searchsorted(x.ends, x.stop, "right")
                n_best, count_sum = np.diff(np.cumsum(sums, axis=1)[:, cut])
                texts = [hashlib.sha256(t).hexdigest() if t else "" for t in x.group_texts()] if with_groups else [""] * part.num_rows
                own = [np.diff(x.first_a), np.diff(x.first_b), x.per_document(x.common), x.per_document(x.ends), n_best, count_sum]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *map(pa.array, own), pa.array(texts, pa.string())], fields)

    return rows.mapInArrow(look_up, RESULT)


def align_documents(docs: DataFrame, slice_pairs: int = SLICE_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per row of `docs`."""
    rows = materialized(encoded(docs), "encoded")
    counts = materialized(_pair_counts(rows), "pairs")
    n = counts.select(F.approx_count_distinct("pair", 0.02)).first()[0]
    slices = max(1, -(-n // slice_pairs))
    parts = []
    for k in range(slices):

        def wanted(pairs: np.ndarray, k: int = k) -> np.ndarray:
            return (pairs >> 32) % slices == k

        own = counts.where((F.shiftright("pair", 32) % slices) == k)
        known = hashed(own.select("pair").distinct(), n // slices)
        parts.append(_looked_up(rows, known, summed(own, known), wanted, k == 0))
    whole = parts[0]
    if slices > 1:
        for part in parts[1:]:
            whole = whole.unionByName(part)
        same = [F.first(c).alias(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
        whole = whole.groupBy("row").agg(*same, F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"), F.max("groups_sha256").alias("groups_sha256"))
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
