"""Byte-level BPE encoding by depth-first traversal of a trie of distinct words.

A sequence of tokens is the BPE encoding of its bytes exactly if each token encodes to itself
and each neighbouring pair encodes to that pair; and every prefix of an encoding is an
encoding. So the encoding of a word's prefix is known from its last token alone: the one
token that ends there and forms a valid pair with the last token of the prefix before it.
The distinct new words of an Arrow batch are sorted by their bytes, which is the order of a
depth-first walk of their trie; the stack holds the last token at each depth, and a word
starts from the depth it shares with the word before it. Shared prefixes are encoded once.
Reading a word's tokens means following last tokens back to depth 0.

Words and their ids are kept from batch to batch in a table of bounded size, which is emptied
when full; that changes the work and not the result.

Defined results: null text counts as empty and gives no ids. The text of a special token is
that token, wherever it stands. Bytes decoded from ids that aren't UTF-8 become U+FFFD.
Other columns and repeated rows are kept as they are. No rows give no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from array import array
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.json"
KEPT_WORDS = 400_000

_SPACE = r"\t-\r \x85\xa0  -     　"
# Fixed value: the pattern that cuts text into words before the merges.
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def byte_letters() -> dict[str, int]:
    """The printable letter that the vocabulary file writes for each byte, as letter -> byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Trie:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        letters = byte_letters()
        raw = {token: bytes(letters[c] for c in token) for token in content["model"]["vocab"]}
        self.ids = {raw[token]: i for token, i in content["model"]["vocab"].items()}
        self.rank = {(raw[a], raw[b]): i for i, (a, b) in enumerate(content["model"]["merges"])}
        self.bytes = {i: token for token, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.names = [self.bytes.get(i, b"") for i in range(max(self.bytes) + 1)]
        self.sizes = list(map(len, self.names))
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        # Tokens that encode to themselves, by their bytes from the last to the first.
        self.back: dict[int, int] = {}
        self.ends = [-1]
        for token, i in self.ids.items():
            if self.merged(token) == [token]:
                node = 0
                for byte in reversed(token):
                    node = self.back.setdefault(node << 8 | byte, len(self.ends))
                    if node == len(self.ends):
                        self.ends.append(-1)
                self.ends[node] = i

    def merged(self, data: bytes) -> list[bytes]:
        """The merges applied in rank order to a short string; what the trie's states are checked with."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.rank.get((a, b), len(self.rank)), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == len(self.rank):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _pair(self, a: int, b: int) -> bool:
        if len(self.pairs) > KEPT_WORDS:
            self.pairs.clear()
        known = self.pairs[a << 32 | b] = self.merged(self.names[a] + self.names[b]) == [self.names[a], self.names[b]]
        return known

    def insert(self, words: set[str]) -> None:
        """Encode words that aren't known yet, in trie order."""
        back, ends, sizes, pairs = self.back, self.ends, self.sizes, self.pairs
        last = [-1]  # the last token's id at each depth
        before = b""
        for data, word in sorted((w.encode(), w) for w in words):
            shared = 0
            for a, b in zip(before, data):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :]
            for end in range(shared, len(data)):
                node, at = 0, end
                while True:
                    node = back.get(node << 8 | data[at], -1)
                    if node < 0:
                        raise ValueError("the vocabulary lacks a byte")
                    token = ends[node]
                    if token >= 0:
                        if at == 0:
                            break
                        previous = last[at]
                        known = pairs.get(previous << 32 | token)
                        if known is None:
                            known = self._pair(previous, token)
                        if known:
                            break
                    at -= 1
                last.append(token)
            ids, at = [], len(data)
            while at:
                ids.append(last[at])
                at -= sizes[last[at]]
            self.words[word] = struct.pack(f"<{len(ids)}I", *reversed(ids))
            before = data

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        parts: list[list[str]] = []
        for text in texts:
            if self.cut and any(s in text for s in self.special):
                cut = self.cut.split(text)
                words = [w for i, piece in enumerate(cut) for w in ([piece] if i % 2 else _WORD.findall(piece))]
            else:
                words = _WORD.findall(text)
            parts.append(words)
        table = self.words
        fresh = {w for words in parts for w in words}.difference(table)
        if len(table) + len(fresh) > KEPT_WORDS:
            table.clear()
            fresh = {w for words in parts for w in words}
        self.insert(fresh.difference(self.special))
        table |= {s: struct.pack("<I", i) for s, i in self.special.items()}
        return [b"".join(map(table.__getitem__, words)) for words in parts]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.names.__getitem__, array("I", ids))).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def trie(path: str) -> Trie:
    return Trie(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _texts(texts: pa.Array):
    """Slices of about 1 MB of text."""
    texts = pc.fill_null(texts, "")
    group, size = [], 0
    for text in texts:
        group.append(text.as_py())
        size += len(group[-1])
        if size >= 1 << 20:
            yield group
            group, size = [], 0
    if group:
        yield group


def encoder(path: str | None = None):
    """A column function from text to an array of ids."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        import numpy as np

        t, out = trie(path or vocabulary_path()), []
        for group in _texts(texts):
            out += [np.frombuffer(ids, np.int32) for ids in t.encode(group)]
        return pa.array(out, pa.list_(pa.int32()))

    return encode


def digester(path: str | None = None):
    """A column function from text to n_tokens, ids_sha256, decoded_sha256 (hex)."""

    @F.arrow_udf("struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>")
    def digest(texts: pa.Array) -> pa.Array:
        t, out = trie(path or vocabulary_path()), []
        for group in _texts(texts):
            for ids in t.encode(group):
                out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.decode(ids).encode()).hexdigest()))
        n, ids, decoded = zip(*out) if out else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return digest


def encode_documents(docs: DataFrame, text: str | Column = "text", path: str | None = None) -> Column:
    """The ids of a text column."""
    return encoder(path)(F.col(text).cast("string") if isinstance(text, str) else text)


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: one row per row of `docs`."""
    return docs.select("doc_id", digester(path)(F.col("text").cast("string")).alias("d")).select("doc_id", "d.*")
