"""Ids of texts under the public vocabularies, and the bytes that each id stands for.

Encoders are built once per Python worker. `ByteVocabulary` gives the ids that the
vocabulary's own library gives: with `special`, the strings of special tokens are those tokens,
without it they are plain text. A text that the word pattern's engine gives up on (millions of
blanks) is cut into words by the other engine of this package, which has no such limit.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import bpe

BYTES = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


class ByteVocabulary:
    """A byte-level vocabulary; `path` and `ranks` are its two files, by default the public ones."""

    def __init__(self, path: str | None = None, ranks: str | None = None) -> None:
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path(BYTES), encoding="utf-8") as file:
            added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
        with open(ranks or public_tokenizers.path(RANKS), "rb") as file:
            known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.special = added
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.encoding = tiktoken.Encoding("byte", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens=added)
        named = {i: token for token, i in known.items()} | {i: s.encode() for s, i in added.items()}
        self.names = [named.get(i, b"") for i in range(max(named) + 1)]

    def encode(self, text: str, special: bool = True) -> np.ndarray:
        try:
            return self.encoding.encode_to_numpy(text, allowed_special="all" if special else set(), disallowed_special=())
        except ValueError:
            return np.array(self._by_words(text, special), np.uint32)

    def _by_words(self, text: str, special: bool) -> list[int]:
        parts = self.cut.split(text) if special and self.cut else [text]
        ids: list[int] = []
        for at, part in enumerate(parts):
            if at % 2:
                ids.append(self.special[part])
            else:
                for word in bpe._WORD.findall(part):
                    ids += self.encoding._encode_single_piece(word.encode())
        return ids


class PieceVocabulary:
    """A vocabulary of pieces with byte fallback, which puts a space before the text."""

    def __init__(self, path: str | None = None) -> None:
        import public_tokenizers
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(PIECES))
        self.names = [self._bytes(i) for i in range(self.model.get_piece_size())]

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), np.uint32)


def runs_of(batch: pa.RecordBatch, *columns: int, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts or ids in these columns have about `limit` bytes, or of one long row."""
    size = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    ends = np.cumsum(size)
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + limit, "right")))
        yield batch.slice(low, high - low)
        low = high


def packed(ids: np.ndarray, size: int) -> bytes:
    """Ids as little-endian integers of two bytes where the vocabulary's `size` allows it, else of four."""
    return ids.astype(id_type(size)).tobytes()


def id_type(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


@lru_cache(maxsize=2)
def byte_vocabulary(path: str | None = None, ranks: str | None = None) -> ByteVocabulary:
    return ByteVocabulary(path, ranks)


@lru_cache(maxsize=2)
def piece_vocabulary(path: str | None = None) -> PieceVocabulary:
    return PieceVocabulary(path)
