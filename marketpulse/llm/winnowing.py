"""Document fingerprints by winnowing, in DataFrame functions only.

The hash of a run of K words is a polynomial of its word hashes over bits (shift and exclusive
or), the value that the rolling update ((g xor first << 28) << 7) xor next gives. From each window of WINDOW runs the smallest hash
is chosen, the rightmost among equals, and kept with its position. So any K + WINDOW - 1 equal
words in two texts are certain to share a fingerprint. A fingerprint entry is one number: 37
bits of hash above 26 bits that fall with the position, so that the minimum of a window is
the minimum of these numbers.

`edited_pairs` needs the next document by doc_id. Documents are sliced at quantiles of
doc_id, about SLICE_CHARS of text each; the first of a slice is also sent, as a guard, to the
end of the slice before it, the first of all to the end of the last.

Defined results: null text counts as empty and has no entries; likeness of two empty
fingerprints is 1, of an empty and another 0. Fewer than K words are one run (missing words count as 0), fewer than
WINDOW runs one window. Equal doc_id are ordered by text, null doc_id come first. Only a
single row has itself as next. No rows give no rows. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import let, starts, words

K = 5
WINDOW = 8
SLICE_CHARS = 2_000_000
SLICES = 10_000
SHIFT = 7

_POSITION_BITS = 26
_LAST_POSITION = (1 << _POSITION_BITS) - 1


def fingerprint(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """The chosen (hash, position) entries as numbers, in order of position."""

    def run(hashes: Column, i: Column) -> Column:
        mixed = reduce(lambda a, b: a.bitwiseXOR(b), [F.shiftleft(F.get(hashes, i + j), (k - 1 - j) * SHIFT) for j in range(k)])
        return F.shiftleft(F.shiftrightunsigned(mixed, _POSITION_BITS + 1), _POSITION_BITS).bitwiseOR(F.lit(_LAST_POSITION) - i)

    def runs(hashes: Column) -> Column:
        return F.transform(starts(F.size(hashes) - (k - 1)), lambda i: run(hashes, i))

    def chosen(values: Column) -> Column:
        return F.array_distinct(F.transform(starts(F.size(values) - (window - 1)), lambda i: F.least(*[F.get(values, i + j) for j in range(window)])))

    hashed = F.transform(words(text), lambda w: F.xxhash64(w))
    padded = let(hashed, lambda h: F.concat(h, F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(0), F.lit(k) - F.size(h)))))
    return F.when(~F.regexp_like(text, F.lit(r"[^\x20\x09-\x0D]")), F.array().cast("array<long>")).otherwise(let(padded, lambda h: let(runs(h), chosen)))


def hashes(entries: Column) -> Column:
    """The distinct hashes of a fingerprint, without positions."""
    return F.array_distinct(F.transform(entries, lambda e: F.shiftright(e, _POSITION_BITS)))


def positions(entries: Column) -> Column:
    """The word position of each entry."""
    return F.transform(entries, lambda e: F.lit(_LAST_POSITION) - e.bitwiseAND(F.lit(_LAST_POSITION)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def _digest(entries: Column) -> Column:
    return F.sha2(F.array_join(entries.cast("array<string>"), ","), 256)


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Each document with its edited text: the last quarter replaced by the start of the next document.

    doc_id, n_chars, edited_text, entries, edited_entries, near_edited, near_next.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    order = F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long"))
    chars, low = narrow.agg(F.sum(F.length("text")), F.min(order)).first()
    slices = min(SLICES, 1 + (chars or 0) // SLICE_CHARS)
    cuts = []
    if slices > 1:  # at most SLICES numbers
        found = narrow.agg(F.percentile_approx(order, [i / slices for i in range(1, slices)], 100 * slices)).first()[0]
        cuts = sorted({c for c in found if c != low})
    bounds = F.from_json(F.lit(str(cuts)), "array<long>")
    slot = F.size(F.filter(bounds, lambda c: c <= F.col("order")))
    guard = F.when(F.col("order") == F.lit(low if low is not None else 0), F.lit(len(cuts))).when(F.array_contains(bounds, F.col("order")), F.col("slot") - 1)
    own = F.struct(F.col("slot").alias("slice"), F.lit(0).alias("guard"))
    places = F.when(guard.isNull(), F.array(own)).otherwise(F.array(own, F.struct(guard.alias("slice"), F.lit(1).alias("guard"))))
    sliced = narrow.withColumn("entries", fingerprint(F.col("text"))).withColumn("order", order).withColumn("slot", slot)
    sliced = sliced.select("doc_id", "text", "entries", "order", F.explode(places).alias("place")).select("*", "place.*").drop("place")
    following = Window.partitionBy("slice").orderBy("guard", "order", "text")
    paired = sliced.withColumn("next", F.lead(F.struct("text", "entries")).over(following)).where("guard = 0")
    size = F.length("text").cast("long")
    quarter = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - quarter), F.substring("next.text", F.lit(1), quarter))
    paired = paired.select("doc_id", size.alias("n_chars"), edited.alias("edited_text"), "entries", F.col("next.entries").alias("next_entries"))
    marked = paired.withColumn("edited_entries", fingerprint(F.col("edited_text")))
    return marked.select(
        "doc_id",
        "n_chars",
        "edited_text",
        "entries",
        "edited_entries",
        let(hashes(F.col("entries")), lambda h: F.struct(likeness(h, hashes(F.col("edited_entries"))).alias("edited"), likeness(h, hashes(F.col("next_entries"))).alias("next"))).alias("near"),
    ).select("doc_id", "n_chars", "edited_text", "entries", "edited_entries", F.col("near.edited").alias("near_edited"), F.col("near.next").alias("near_next"))


def fingerprint_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_entries."""
    return edited_pairs(docs).select(
        "doc_id",
        "n_chars",
        F.sha2("edited_text", 256).alias("edited_sha256"),
        _digest(F.col("entries")).alias("fingerprint"),
        _digest(F.col("edited_entries")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        F.size("entries").cast("long").alias("n_entries"),
    )
