"""Packing, alignment and the manifest against plain versions, and on odd, repeated and empty rows."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from marketpulse.llm import alignment, merkle, packing
from marketpulse.llm.bpe import byte_letters

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, row long, part string, place int"


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, repeated and tied rows, long texts, special strings, clashing column names."""
    long = " ".join(f"word{i % 977}" for i in range(20_000))
    texts = [(1, None), (2, ""), (3, " \t\n "), (4, "One two"), (5, "One two"), (5, "One two"), (5, "other"), (None, "no ID here"), (None, "nor here"), (7, long), (8, long + " END")]
    texts += [(9, "é" * 3000), (10, "a<|endoftext|>b </s> <unk> ▁x"), (11, "a▁b"), (12, "🙂 日本語 é \x00\x85"), (13, "Z" * 5000), (15, "ABC"), (25, " " * 3000 + "x")]
    rows = [(i, t, None if i == 4 else "en", ["a", "b", None][k % 3], k, "x", 1, "y", 2) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def byte_bpe():
    import public_tokenizers
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.no_truncation()
    found.no_padding()
    return found


def check_packing(rows, docs, tokenizer, window):
    """Every row's ids lie in gapless pieces, every window's pieces are gapless; returns the windows' lengths."""
    tokenizer.encode_special_tokens = False
    want = collections.Counter()
    for d in docs:
        ids = np.array([*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 1], "<u4")
        want[d.doc_id] += len(ids)
        own = [p for p in rows if p.doc_id == d.doc_id and p.doc_tokens == len(ids)]
        assert own
        for p in own:
            if sum(x.doc_id == d.doc_id for x in docs) == 1:
                assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    got, windows, starts = collections.Counter(), collections.defaultdict(list), collections.defaultdict(list)
    for p in rows:
        got[p.doc_id] += p.length
        windows[p.sequence_id].append((p.offset, p.length))
        starts[p.doc_id].append((p.start, p.length))
    assert got == want
    for d, pieces in starts.items():
        if sum(x.doc_id == d for x in docs) == 1:
            assert all(a + n == b for (a, n), (b, _) in zip(sorted(pieces), sorted(pieces)[1:]))
    for pieces in windows.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:]))
    lengths = [sum(n for _, n in pieces) for pieces in windows.values()]
    assert max(lengths) <= window
    return lengths


def test_packing(docs, byte_bpe):
    lengths = check_packing(packing.pack_documents(docs).collect(), docs.collect(), byte_bpe, 2048)
    assert sum(2048 - n for n in lengths) < 0.01 * sum(lengths)


def test_packing_of_odd_rows_in_small_shards(odd, byte_bpe):
    lengths = check_packing(packing.pack_documents(odd, window=64, shard_tokens=500, shard_rows=4, part_tokens=2000).collect(), odd.collect(), byte_bpe, 64)
    assert sum(n < 64 for n in lengths) <= max(1, sum(lengths) // 2000)
    assert packing.pack_documents(odd.limit(0)).count() == 0


def test_neighbours_come_by_score():
    rng = np.random.default_rng(3)
    topics = [rng.integers(100 * t, 100 * t + 40, size=(12, 50)).astype(np.uint32) for t in range(5)]
    rests = [(int(k), ids, 0) for k, ids in enumerate(np.concatenate(topics)[rng.permutation(60)])]
    everything = np.concatenate([x for _, x, _ in rests])
    counts = collections.Counter(t for _, x, _ in rests for t in set(x.tolist()))
    model = packing.Bm25(counts, 60, 50.0)
    index = packing._Index([x for _, x, _ in rests], model)

    def plain(query, ids):
        tf = collections.Counter(ids.tolist())
        return sum(np.log(1 + (60 - counts[t] + 0.5) / (counts[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(ids) / 50)) for t in set(query.tolist()) if t in tf)

    for seed in (0, 7):
        assert index.scores(seed) == pytest.approx([plain(rests[seed][1], x) for _, x, _ in rests], abs=1e-4)
    windows, left = packing.fill(rests, model, 300, False)
    assert not left and len(windows) == 10 and len(everything) == 3000
    assert all(len({int(ids[0]) // 100 for (_, ids, _), _ in w}) == 1 for w in windows)  # one topic a window


def aligned_plainly(docs, tokenizer):
    import public_tokenizers
    import sentencepiece

    tokenizer.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters, names = byte_letters(), {i: t for t, i in tokenizer.get_vocab().items()}

    def name_b(i):
        return bytes([int(re.fullmatch("<0x(..)>", pieces.id_to_piece(i))[1], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()

    own = []
    for d in docs:
        a, b = (tokenizer.encode(" " + d.text, add_special_tokens=False).ids, pieces.encode(d.text)) if d.text else ([], [])
        bytes_a, bytes_b = [bytes(letters[c] for c in names[i]) for i in a], [name_b(i) for i in b]
        if not d.text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + d.text).encode():
            own.append((d.doc_id, [], [], [], []))
            continue
        ends_a, ends_b = np.cumsum([*map(len, bytes_a)]).tolist(), np.cumsum([*map(len, bytes_b)]).tolist()
        links, i, j = [], 0, 0
        while i < len(a):
            links.append((a[i], b[j]))
            x, y = ends_a[i], ends_b[j]
            i, j = i + (x <= y), j + (y <= x)
        groups, low = [], 0
        for high in sorted({*ends_a} & {*ends_b}):
            groups.append("|".join(",".join(str(t) for t, e in zip(ids, ends) if low < e <= high) for ids, ends in ((a, ends_a), (b, ends_b))))
            low = high
        own.append((d.doc_id, a, b, links, groups))
    counts = collections.Counter(x for o in own for x in o[3])
    best = collections.defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return collections.Counter(
        (d, len(a), len(b), len(g), len(x), sum(counts[y] == best[y[1]] for y in x), sum(counts[y] for y in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for d, a, b, x, g in own
    )


@pytest.mark.parametrize("slice_pairs", [alignment.SLICE_PAIRS, 60])
def test_alignment(odd, byte_bpe, slice_pairs):
    short = odd.where("doc_id is null or doc_id not in (7, 8)")
    got = collections.Counter(map(tuple, alignment.align_documents(short, slice_pairs).collect()))
    assert got == aligned_plainly(short.collect(), byte_bpe)
    assert alignment.align_documents(odd.limit(0)).count() == 0


def test_alignment_of_documents(docs, byte_bpe):
    some = docs.where("n_chars < 4000")
    assert collections.Counter(map(tuple, alignment.align_documents(some).collect())) == aligned_plainly(some.collect(), byte_bpe)


def test_hash_is_minimal_and_perfect_and_verified():
    keys = np.unique(np.random.default_rng(5).integers(0, 1 << 40, 20_000))
    bucket = alignment._place(keys, -2, 3)
    built = []
    for k in range(3):
        levels, ordered = alignment.hash_levels(keys[bucket == k])
        built.append((k, [len(x) for x in levels], np.packbits(np.concatenate(levels)).tobytes(), ordered.astype("<i8").tobytes()))
    table = alignment.PairHash(built, 3)
    assert sorted(table.numbers(keys)) == list(range(len(keys)))
    with pytest.raises(ValueError):
        table.numbers(np.array([1 << 41]))


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def manifest_plainly(rows):
    def leaf(r, text):
        return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))

    def tree(nodes):
        levels = [nodes]
        while len(nodes) > 1:
            nodes = [digest("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
            levels.append(nodes)
        return levels

    def path(levels, i):
        for level in levels[:-1]:
            low = i // 16 * 16
            yield "".join(level[low:i]), "".join(level[i + 1 : low + 16])
            i //= 16

    order = sorted({r.source for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    members = {s: sorted((r for r in rows if r.source == s), key=lambda r: (r.doc_id is not None, r.doc_id, leaf(r, r.text))) for s in order}
    trees = [tree([leaf(r, r.text) for r in members[s]]) for s in order]
    top, out = tree([t[-1][0] for t in trees]), []
    for k, s in enumerate(order):
        for i, r in enumerate(members[s]):
            siblings, text = [*path(trees[k], i), *path(top, k)], r.text
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and text:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            folded = leaf(r, text)
            for before, after in siblings:
                folded = digest(before + folded + after)
            root = top[-1][0]
            out.append((r.doc_id, trees[k][0][i], trees[k][-1][0], root, digest("".join(a + b for a, b in siblings)), folded, folded == root))
    return collections.Counter(out)


def test_manifest(docs, odd):
    for table in (docs, odd, odd.where("doc_id = 1")):
        assert collections.Counter(map(tuple, merkle.manifest_proofs(table).collect())) == manifest_plainly(table.collect())
    assert any(not r.verified for r in merkle.manifest_proofs(docs).collect())
    assert merkle.manifest_proofs(docs.limit(0)).count() == 0


def test_manifest_of_many_sources(spark):
    # more sources than one run, one source larger than a run of runs
    rows = [(i, f"Text {i}", "en", f"s{i % 40}" if i < 80 else "hot", i) for i in range(700)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert collections.Counter(map(tuple, merkle.manifest_proofs(table).collect())) == manifest_plainly(table.collect())
