"""Packing documents into windows of tokens next to their lexical neighbours.

Every document is its ids and an end token. Windows of WINDOW tokens are cut from the front of
long documents; what is left of a document, less than a window, is filled up with its
neighbours: a BM25 index of the shard's rests, over token ids, returns the unused rests best
first for the rest that opens a window, and they are placed until the window is full. The
one that doesn't fit is cut, and what is left of it opens the next window. Rests without
a shared token rank last in the shard's order, so all are placed and windows are full.

Token ids are the terms, so the statistics (documents per token) have at most as many rows as
the vocabulary; they are counted over all documents and sent to the tasks. Shards are runs
of at most SHARD_TOKENS tokens or SHARD_ROWS rests of the table in order of the documents'
two most telling tokens (the highest BM25 weight), so documents of a topic, and copies, stand
in the same shard whatever their place in the table; ties are spread by a hash, so a large
group of copies is cut into many shards. A task holds one shard. What a shard leaves over,
less than a window, goes on to the next shard of the task; the last window of a task is
padded, which is one in PART_TOKENS / WINDOW or fewer where there is so much text.

Defined results: null or empty text is the end token alone. Equal rows are packed like others.
No rows give no rows. Other columns don't count. A document's pieces are gapless from 0; a
piece lies in one window, and a window's pieces are gapless from 0.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialized
from .vocabularies import byte_vocabulary, id_type, packed, runs_of

WINDOW = 2048
END = 1
SHARD_TOKENS = 1 << 19
SHARD_ROWS = 1 << 12
PART_TOKENS = 1 << 20
#: Tasks hold more tokens than PART_TOKENS where there would be more of them than this many a core.
TASKS_A_CORE = 4
MOST_PART_TOKENS = 1 << 25
K1, B = 1.2, 0.75

ENCODED = "doc_id long, ids binary, n long"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encoded(docs: DataFrame, path: str | None = None, ranks: str | None = None) -> DataFrame:
    """doc_id, ids (packed, with the end token) and their number, for every row."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = byte_vocabulary(path, ranks)
        end = np.array([END], np.uint32)
        for batch in batches:
            for part in runs_of(batch, 1):
                ids = [np.concatenate((vocabulary.encode(t.as_py() or ""), end)) for t in part.column(1)]
                column = pa.array([packed(x, len(vocabulary.names)) for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), column, pa.array(map(len, ids), pa.int64())], ["doc_id", "ids", "n"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(encode, ENCODED)


def _terms(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, token, times) of the distinct tokens of each row, by row and token."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    owner = np.repeat(np.arange(len(ids), dtype=np.int64), sizes)
    found, times = np.unique(owner << 32 | np.concatenate([*ids, np.empty(0, np.int64)]).astype(np.int64), return_counts=True)
    return found >> 32, found & 0xFFFFFFFF, times


def _ids(column: pa.Array) -> list[np.ndarray]:
    kind = id_type(len(byte_vocabulary().names))
    return [np.frombuffer(x.as_py(), kind) for x in column]


def token_counts(rows: DataFrame) -> DataFrame:
    """token, documents: in how many rows each token is; at most as many rows as the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for part in runs_of(batch, 0):
                _, token, _ = _terms(_ids(part.column(0)))
                if len(token):
                    if token.max() >= len(total):
                        total = np.concatenate((total, np.zeros(token.max() + 1 - len(total), np.int64)))
                    total += np.bincount(token, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["token", "documents"])

    parts = rows.select("ids").mapInArrow(count, "token long, documents long")
    return parts.groupBy("token").agg(F.sum("documents").alias("documents"))


class Bm25:
    """Weights of tokens in documents."""

    def __init__(self, counts: dict[int, int], documents: int, average: float) -> None:
        seen = np.zeros(max(counts, default=0) + 1)
        for token, n in counts.items():
            seen[token] = n
        self.idf = np.log1p((documents - seen + 0.5) / (seen + 0.5)).astype(np.float32)
        self.average = max(average, 1.0)

    def weights(self, token: np.ndarray, times: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self.idf[token] * (times * (K1 + 1) / (times + K1 * (1 - B + B * length / self.average))).astype(np.float32)


def _routed(rows: DataFrame, model: Bm25) -> DataFrame:
    """The rows with their two most telling tokens, and a hash for ties."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in runs_of(whole, 1)):
            ids = _ids(batch.column(1))
            row, token, times = _terms(ids)
            length = np.fromiter(map(len, ids), np.int64, len(ids))
            value = model.weights(token, times, length[row])
            best = np.lexsort((token, -value, row))
            first = np.searchsorted(row, np.arange(len(ids)))
            many = np.diff(np.append(first, len(row))) > 1
            token = np.append(token[best], 0)
            one, two = token[first], np.where(many, token[first + many], -1)
            spread = np.fromiter((zlib.crc32(b"%d" % (i.as_py() or 0), zlib.crc32(x)) for i, x in zip(batch.column(0), ids)), np.int64, len(ids))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(spread)], [*batch.schema.names, "one", "two", "spread"])

    return rows.mapInArrow(route, f"{ENCODED}, one long, two long, spread long")


class _Index:
    """Postings of a shard's rests by token, with their BM25 weights."""

    def __init__(self, rests: list[np.ndarray], model: Bm25) -> None:
        self.n = len(rests)
        row, token, times = _terms(rests)
        self.token, self.first = token, np.searchsorted(row, np.arange(self.n + 1))
        length = np.fromiter(map(len, rests), np.int64, self.n)
        by_token = np.argsort(token, kind="stable")
        self.row = row[by_token]
        self.weight = model.weights(token, times, length[row])[by_token]
        self.begin = np.searchsorted(token[by_token], np.arange(len(model.idf) + 1))

    def scores(self, seed: int) -> np.ndarray:
        """The score of every rest for the tokens of rest `seed`."""
        terms = self.token[self.first[seed] : self.first[seed + 1]]
        begin = self.begin[terms]
        sizes = self.begin[terms + 1] - begin
        at = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return np.bincount(self.row[at], weights=self.weight[at], minlength=self.n)


#: What is left of a document: doc_id, its ids, how many of them are placed.
Rest = tuple[int | None, np.ndarray, int]


def fill(rests: list[Rest], model: Bm25, window: int, last: bool) -> tuple[list[list[tuple[Rest, int]]], list[Rest]]:
    """Windows as lists of (rest, length), and what is left over; with `last` nothing is, and the last window may be short."""
    index = _Index([ids[at:] for _, ids, at in rests], model)
    start = np.array([at for _, _, at in rests], np.int64)
    left = np.array([len(ids) - at for _, ids, at in rests], np.int64)
    total, opener, cut, windows = int(left.sum()), 0, -1, []
    while total and (last or total >= window):
        if cut >= 0 and left[cut]:
            seed = cut
        else:
            while not left[opener]:
                opener += 1
            seed = opener
        space, pieces, cut = window, [], -1
        scores = index.scores(seed)
        scores[seed] = np.inf
        unused = np.flatnonzero(left)
        for k in unused[np.argsort(-scores[unused], kind="stable")]:
            size = int(min(space, left[k]))
            doc_id, ids, _ = rests[k]
            pieces.append(((doc_id, ids, int(start[k])), size))
            start[k] += size
            left[k] -= size
            space -= size
            if left[k]:
                cut = int(k)
            if not space:
                break
        total -= window - space
        windows.append(pieces)
    order = np.flatnonzero(left)
    if cut >= 0 and left[cut]:
        order = np.concatenate(([cut], order[order != cut]))
    return windows, [(rests[k][0], rests[k][1], int(start[k])) for k in order]


def _packed(rows: DataFrame, model: Bm25, window: int, shard_tokens: int, shard_rows: int) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        out: list[tuple] = []
        rests: list[Rest] = []
        tokens = 0

        def write(windows: list[list[tuple[Rest, int]]]) -> None:
            nonlocal sequence
            for pieces in windows:
                offset = 0
                for (doc_id, ids, start), size in pieces:
                    out.append((doc_id, start, size, zlib.crc32(ids[start : start + size].astype("<u4")), len(ids), sequence, offset))
                    offset += size
                sequence += 1

        def batch_of() -> pa.RecordBatch:
            names = [f.split()[0] for f in PIECES.split(", ")]
            table = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)
            out.clear()
            return table

        for batch in (part for whole in batches for part in runs_of(whole, 1)):
            for doc_id, ids in zip(batch.column(0).to_pylist(), _ids(batch.column(1))):
                whole = len(ids) // window * window
                write([[((doc_id, ids, at), window)] for at in range(0, whole, window)])
                if whole < len(ids):
                    rests.append((doc_id, ids, whole))
                    tokens += len(ids) - whole
                if tokens >= shard_tokens or len(rests) >= shard_rows:
                    windows, rests = fill(rests, model, window, False)
                    tokens = sum(len(x) - at for _, x, at in rests)
                    write(windows)
                if len(out) >= 10_000:
                    yield batch_of()
        if rests:
            write(fill(rests, model, window, True)[0])
        if out:
            yield batch_of()

    return rows.select("doc_id", "ids").mapInArrow(pack, PIECES)


def pack_documents(
    docs: DataFrame, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, shard_rows: int = SHARD_ROWS, part_tokens: int = PART_TOKENS
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece of a document."""
    rows = materialized(encoded(docs), "encoded")
    n, tokens, rest = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.avg(F.col("n") % window), F.lit(0.0))).first()
    counts = dict(map(tuple, token_counts(rows).collect()))  # at most one row per token of the vocabulary
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(1, math.ceil(tokens / MOST_PART_TOKENS), min(TASKS_A_CORE * cores, tokens // part_tokens))
    routed = _routed(rows, Bm25(counts, n, rest))
    order = ["one", "two", "spread", "doc_id"]
    shards = routed.repartitionByRange(parts, *order).sortWithinPartitions(*order, "ids")
    return _packed(shards, Bm25(counts, n, rest), window, shard_tokens, shard_rows)
