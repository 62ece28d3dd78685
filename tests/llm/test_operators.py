"""Every operator on the whole small tables, and on empty, null, tied, repeated and clashing rows."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marketpulse.llm import bpe, context_mixing, importance, mixing, near_duplicates, outliers, personal_data, secrets, sharding, winnowing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark, small):
    return spark.read.parquet(f"{small}/labels.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, an empty and a blank text, repeated and tied rows, a very long text, clashing column names."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one two"), (5, "one two"), (5, "one two"), (None, "no id here at all"), (7, long), (8, long + " end"), (9, "é" * 3000)]
    return spark.createDataFrame([(i, t, None, None, 0, "x", 1.0, "y") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, node string, score double, kept string")


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


OPERATORS = {
    "importance": lambda d, x: importance.importance_sample(d, x),
    "context_mixing": lambda d, x: context_mixing.language_model_scores(d),
    "winnowing": lambda d, x: winnowing.fingerprint_digests(d),
    "sharding": lambda d, x: sharding.shard_documents(d),
    "mixing": lambda d, x: mixing.document_rates(d, x),
    "outliers": lambda d, x: outliers.judged(d),
    "bpe": lambda d, x: bpe.token_digests(d),
    "personal_data": lambda d, x: personal_data.personal_data(d),
    "secrets": lambda d, x: secrets.scan_documents(d),
    "near_duplicates": lambda d, x: near_duplicates.near_duplicates(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_and_empty_tables(odd, no_labels, name):
    out = OPERATORS[name](odd, no_labels).collect()
    assert collections.Counter(r.doc_id for r in out) == collections.Counter([1, 2, 3, 4, 5, 5, None, 7, 8, 9])
    assert OPERATORS[name](odd.limit(0), no_labels).count() == 0


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]], ids=[n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns(spark, odd, no_labels, tmp_path, stage):
    no_labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert stage(spark, odd, str(tmp_path)).columns == odd.columns
    assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0


def test_importance_keeps_good_documents(docs, labels):
    kept = importance.importance_sample(docs, labels).join(labels.where("toxic = 0").dropDuplicates(["doc_id"]), "doc_id")
    share = {r.quality: r.share for r in kept.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert share[1] > 0.95 and share[0] < 0.2
    same = importance.keep_sampled(docs, labels).select("doc_id").collect()
    assert sorted(r.doc_id for r in same) == sorted(r.doc_id for r in importance.importance_sample(docs, labels).where("kept").collect())


def test_language_model_base_score(docs):
    rows = docs.collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 == 1 for r in rows}
    words = {r.doc_id: [*WORD.findall(lower(r.text)), None] for r in rows}
    counts = collections.Counter(w for i, ws in words.items() if not held[i] for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    got = by_id(context_mixing.language_model_scores(docs))
    import math

    for i, ws in words.items():
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(counts[w] > 0 for w in ws), total)
        assert r.base_score == pytest.approx(base, abs=1e-6)
        assert r.score < 0
    bits = -sum(got[r.doc_id].score for r in rows if held[r.doc_id]) / math.log10(2)
    assert bits / sum(len(r.text.encode()) for r in rows if held[r.doc_id]) < 4  # order 0 needs 4.4


def test_language_model_is_a_distribution():
    import numpy as np

    code = context_mixing.huffman(np.arange(257))
    assert sum(2.0 ** -int(n) for n in code.length) == 1.0
    odds = np.random.default_rng(1).normal(size=(context_mixing.CONTEXTS, context_mixing.CELLS)).astype(np.float32)
    one = np.arange(256, dtype=np.uint8)
    total = sum(10 ** context_mixing.log10_probability(one[[b]], np.array([0, 1]), code, odds)[0] for b in range(256))
    total += 10 ** context_mixing.log10_probability(one[:0], np.array([0, 0]), code, odds)[0]
    assert total <= 1.0 + 1e-5
    alone = context_mixing.log10_probability(one[65:70], np.array([0, 5]), code, odds)[0]
    both = context_mixing.log10_probability(np.concatenate((one[90:99], one[65:70])), np.array([0, 9, 14]), code, odds)[1]
    assert alone == pytest.approx(both, rel=1e-6)


def test_winnowing_by_brute_force(docs):
    rows = sorted(docs.select("doc_id", "text").collect())
    got = by_id(winnowing.edited_pairs(docs))
    for i, r in enumerate(rows):
        n, after = len(r.text), rows[(i + 1) % len(rows)].text
        edited = r.text[: n - n // 4] + after[: n // 4]
        out = got[r.doc_id]
        assert (out.n_chars, out.edited_text) == (n, edited)
    equal = collections.defaultdict(set)
    for r in rows:
        equal[r.text].add(tuple(got[r.doc_id].entries))
    assert all(len(v) == 1 for v in equal.values())


def test_winnowing_guarantee(spark):
    words = [f"w{random.Random(i).randrange(10**6)}" for i in range(200)]
    shared = words[50 : 50 + winnowing.K + winnowing.WINDOW - 1]
    rows = [(" ".join(words),), ("a b c " + " ".join(shared) + " d e f",)]
    a, b = (set(r.h) for r in spark.createDataFrame(rows, "t string").select(winnowing.hashes(winnowing.fingerprint(F.col("t"))).alias("h")).collect())
    assert a & b


def test_shards(docs):
    out = sharding.shard_documents(docs).collect()
    sizes = collections.Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes[s] for s in range(sharding.SHARDS)) <= 1
    for shard in sizes:
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sizes[shard]))
    text = {r.doc_id: r.text for r in docs.collect()}
    places = collections.defaultdict(list)
    for r in out:
        assert (r.size, r.text_crc32) == (len(text[r.doc_id].encode()) + 16, zlib.crc32(text[r.doc_id].encode()))
        places[text[r.doc_id]].append(r.shard)
    assert sum(len(set(p)) > 1 for p in places.values()) <= 2


def test_mixing_meets_targets(docs, labels):
    rows = mixing.document_rates(docs, labels).collect()
    totals = [sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in rows) for d in mixing.DOMAINS]
    have = [sum(r.n_tokens * r[f"p_{d}"] for r in rows) for d in mixing.DOMAINS]
    assert all(0 <= r.rate <= mixing.MAX_RATE for r in rows)
    assert totals[0] / sum(totals) > have[0] / sum(have)
    good = {r.doc_id for r in labels.where("quality = 1 and toxic = 0").collect()}
    assert sum(r.copies for r in rows if r.doc_id in good) >= 0.9 * len([r for r in rows if r.doc_id in good])


def test_outlier_statistics_by_brute_force(docs):
    got = by_id(outliers.judged(docs))
    for r in docs.collect():
        words = WORD.findall(r.text)
        lines = [x for x in r.text.split("\n") if WORD.search(x)]
        runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        often = collections.Counter(runs)
        covered = {j for i, x in enumerate(runs) if often[x] > 1 for j in range(i, i + 8)}
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in r.text), len(lines) - len(set(lines)), len(covered))
        out = got[r.doc_id]
        assert (out.n_words, out.word_chars, out.n_symbols, out.n_dup_lines, out.n_repeat_words) == want
        assert out.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (out.base_failed and out.kept)


def test_bpe_as_the_tokenizer(docs):
    tokenizers = pytest.importorskip("tokenizers")
    whole = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
    trie = bpe.Trie(bpe.vocabulary_path())
    rng = random.Random(3)
    texts = [r.text for r in docs.collect()]
    texts += ["", "<|endoftext|>a<|endoftext|>  b\n\n c", "x   y  ", "I'm we'll\t\t'S", "a" * 3000, "日本語 テキスト 😀", "\x1c a\x85 b", "a\x00b"]
    texts += ["".join(chr(rng.choice([32, 9, 10, 65, 39, 0xE9, 0x300, 0x4E00, 0x1F600, rng.randrange(1, 0xD7FF)])) for _ in range(120)) for _ in range(60)]
    for text, ids in zip(texts, trie.encode(texts)):
        want = whole.encode(text, add_special_tokens=False).ids
        assert list(memoryview(ids).cast("I")) == want
        assert trie.decode(ids) == whole.decode(want, skip_special_tokens=False)


def test_bpe_table_that_is_emptied(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)
    trie, other = bpe.Trie(bpe.vocabulary_path()), bpe.Trie(bpe.vocabulary_path())
    texts = ["one two three four five", "two three <|endoftext|> six", "one"]
    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)
    small = [trie.encode([t])[0] for t in texts]
    monkeypatch.setattr(bpe, "KEPT_WORDS", 10**6)
    assert small == other.encode(texts)


def test_personal_data_base_by_plain_patterns(docs):
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    texts = [r.text for r in docs.collect()] + ["a@b.c_d@e.f x@y..z 1.2.3.4.5.6.7.8 300.1.1.1 4111 1111-1111 1111 +1 (2) 3.", "a@@b.c @d.e " + "9" * 500]
    for text in texts:
        want = []
        for k, p in enumerate(patterns):
            for m in re.finditer(p, text):
                digits = re.sub("[^0-9]", "", m.group())
                ok = (True, k == 1 and all(int(x) <= 255 for x in m.group().split(".")), 12 <= len(digits) <= 19 and personal_data.luhn(digits), 9 <= len(digits) <= 15)[k]
                want += [(*m.span(), personal_data.KINDS[k])] if ok else []
        want.sort(key=lambda s: (s[0], personal_data.KINDS.index(s[2])))
        assert personal_data.base_spans(text) == want


def test_personal_data_adds_and_keeps(docs, spark):
    weights = personal_data.fit(docs)
    rows = spark.createDataFrame([(1, "call +1 (826) 555-4081 190.137.2.9 or mail a.b@mail.example.com now"), (2, "Version 3.0 of 12 words")], "doc_id long, text string")
    out = by_id(personal_data.personal_data(rows, weights))
    assert "email:43:63" in out[1].spans and "ip:23:34" in out[1].spans
    assert out[2].spans == "" and out[2].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_secret_forest_on_held_out_findings(docs):
    findings = secrets.labelled_findings(docs)
    half = F.pmod(F.xxhash64("finding"), F.lit(2))
    forest = secrets.fit(findings.where(half == 0))
    words = secrets.dictionary(secrets.vocabulary_path())
    import numpy as np

    rows = findings.where(half == 1).collect()
    scores = forest.score(np.array([secrets.features(r.finding, r.before, words) for r in rows]))
    right = sum((s >= secrets.THRESHOLD) == bool(r.label) for s, r in zip(scores, rows))
    assert right >= 0.9 * len(rows)


def test_secrets_are_masked(spark, docs):
    clean = secrets.redact_documents(docs)
    assert clean.where(F.col("text").rlike('token = "[0-9a-f]{40}"')).count() == 0
    assert clean.count() == docs.count()


def test_near_duplicates_by_brute_force(docs):
    sets = {}
    for r in docs.collect():
        w = WORD.findall(lower(r.text))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = by_id(near_duplicates.near_duplicates(docs))
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), root(i), root(i) == i) for i in ids}
    assert near_duplicates.drop_near_duplicates(docs).count() == len({root(i) for i in ids})


def test_near_duplicates_in_chains_and_copies(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(100)]
    rows, at = [(0, " ".join(words))], list(words)
    for i in range(1, 12):  # each differs from the one before by one word near the end
        at = list(at)
        at[8 * i % 100] = f"new{rng.random()}"
        rows.append((i, " ".join(at)))
    rows += [(100 + i, rows[0][1].upper()) for i in range(50)]
    out = by_id(near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {r.component_id for r in out.values()} == {0}


def test_pipeline_runs(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert 0 < out.count() < spark.read.parquet(f"{small}/documents.parquet").count()
