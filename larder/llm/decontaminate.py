"""Benchmark decontamination by greedy string tiling.

Rolling word hashes of documents are joined with those of benchmark items; a shared hash is a seed. Seeds
name the pairs of document and item that could share enough; each pair is then tiled by running
Karp-Rabin over its two sequences of seeds: texts are read once and never shuffled. The share of an
item's words that tiles cover is the same in whatever order its passages stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import bits_for, fresh, handed_back, is_marked, marked, row_key, sized, written
from larder.llm.textops import ALNUM, power, rolling, slices, word_hashes

KEY = ["key_a", "key_b"]


def item_grams(items: DataFrame, k: int) -> DataFrame:
    """(item, item_id, n_words, size, grams array<long>) of every item that has words, as a stored table:
    the hashes of its runs of `size` words in order, size being k, or all words of a shorter item. `item`
    numbers the rows."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            hashes, counts = word_hashes(batch.column(1), ALNUM)
            ends = np.cumsum(counts)
            rows = [
                (i, n, min(k, n), rolling(hashes[end - n : end], np.array([n]), min(k, n))[0].view(np.int64))
                for i, n, end in zip(batch.column(0).to_pylist(), counts.tolist(), ends.tolist())
                if n
            ]
            columns = list(zip(*rows)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["item_id", "n_words", "size", "grams"])

    found = items.select("item_id", "text").mapInArrow(handed_back(of), "item_id long, n_words long, size int, grams array<long>")
    return written(found.withColumn("item", F.monotonically_increasing_id()), "items")


def seeds(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(key_a, key_b, size, pos array<int>, grams array<long>): for each text, and each size of run that
    items have, the places whose hash an item may have. A bitmap spares nearly all others; its size is set
    by the number of hashes, up to a bound. docs: (key_a, key_b, text)."""
    hashes = items.select(F.explode("grams").alias("h"))
    bits = marked(hashes, bits_for(hashes.count(), 1 << 20))
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # k at most
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2)):
            hashes, counts = word_hashes(batch.column(2), ALNUM)
            for size in sizes:
                h, text, at = rolling(hashes, counts, size)
                good = is_marked(shared.value, h)
                h, text, at = h[good], text[good], at[good]
                some, first = np.unique(text, return_index=True)
                bounds = pa.array(np.append(first, len(text)).astype(np.int32))
                rows = pa.array(some)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(rows),
                        batch.column(1).take(rows),
                        pa.array(np.full(len(some), size, np.int32)),
                        pa.ListArray.from_arrays(bounds, pa.array(at.astype(np.int32))),
                        pa.ListArray.from_arrays(bounds, pa.array(h.view(np.int64))),
                    ],
                    names=[*KEY, "size", "pos", "grams"],
                )

    return docs.select(*KEY, "text").mapInArrow(handed_back(of), "key_a long, key_b long, size int, pos array<int>, grams array<long>")


def _windows(pos: np.ndarray, total: np.ndarray, down: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """(first gram, hash) of every `run` grams that stand at places following one another."""
    first = np.arange(len(pos) - run + 1)
    first = first[pos[run - 1 :] - pos[: len(first)] == run - 1]
    return first, (total[first + run] - total[first]) * down[first]


def tiles(pos: np.ndarray, doc: np.ndarray, item: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (pos, at, words) of the tiles. doc has hashes of runs of k words at the
    places `pos` (rising), item those of every place of the item.

    The longest passage free of marks comes first, of equals the first in the item, then in the document;
    its words are marked on both sides. Lengths are found by halving: a passage is common if the rolling
    hash of its grams is. Marks are never shorter than the passages looked for, so a passage is free if
    its ends are. Memory grows with the sum of both lengths, not with their product.
    """
    some = np.isin(doc, item)
    pos, doc = pos[some].astype(np.int64), doc[some]
    if not len(doc):
        return []
    at = np.arange(len(item))
    up, down = power(max(len(doc), len(item)) + 1)
    total_d, total_i = (np.concatenate((np.zeros(1, np.uint64), np.cumsum(x.view(np.uint64) * up[: len(x)], dtype=np.uint64))) for x in (doc, item))
    free_d, free_i = np.ones(int(pos[-1]) + k, dtype=bool), np.ones(len(item) + k - 1, dtype=bool)

    def common(words: int):
        """Free windows of `words` words on both sides, those in the document by hash and place, and
        which of the item's are among them."""
        sides = []
        for places, total, free in ((pos, total_d, free_d), (at, total_i, free_i)):
            first, h = _windows(places, total, down, words - k + 1)
            p = places[first]
            good = free[p] & free[p + words - 1]
            sides.append((p[good], h[good]))
        (p, h), (a, g) = sides
        order = np.lexsort((p, h))
        p, h = p[order], h[order]
        start = np.searchsorted(h, g)
        met = h[np.minimum(start, len(h) - 1)] == g if len(h) else np.zeros(len(g), dtype=bool)
        return p, h, a[met], start[met]

    out = []
    longest = min(len(item), int(pos[-1]) + 1) + k - 1
    while longest >= k:
        low, high = k - 1, longest  # passages of `low` words are common (or low is k - 1), none over `high`
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(common(middle)[2]) else (low, middle - 1)
        if low < k:
            break
        p, h, a, start = common(low)
        next_: dict[int, int] = {}
        for place, s in zip(a.tolist(), start.tolist()):
            if not (free_i[place] and free_i[place + low - 1]):
                continue
            i = next_.get(s, s)
            while i < len(p) and h[i] == h[s] and not (free_d[p[i]] and free_d[p[i] + low - 1]):
                i += 1
            next_[s] = i
            if i < len(p) and h[i] == h[s]:
                out.append((int(p[i]), place, low))
                free_d[p[i] : p[i] + low] = False
                free_i[place : place + low] = False
        longest = low - 1
    return out


def overlaps(docs: DataFrame, items: DataFrame, k: int = 4, threshold: float = 0.5) -> DataFrame:
    """(key_a, key_b, item, item_id, coverage, tiles array of (pos, at, words)) of pairs of at least
    `threshold`.

    docs: (key_a, key_b, text), the key telling rows apart; items: (item_id, text). Words are runs of
    digits, letters and non-ASCII characters, A-Z as a-z. Items of fewer than k words are looked for as a
    whole; items without words match nothing.
    """
    items = item_grams(items, k)
    # rows alike in their key have alike seeds: one of them is enough
    found = written(seeds(docs, items).dropDuplicates([*KEY, "size"]), "seeds")
    places = items.select("item", "n_words", "size", F.posexplode("grams").alias("at", "h"))
    places = places.groupBy("size", "h", "item", "n_words").agg(F.collect_list("at").alias("ats"))
    covered = F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("ats")), lambda a: F.sequence(a, a + F.col("size") - 1))))
    pairs = (
        found.select(*KEY, "size", F.explode(F.array_distinct("grams")).alias("h"))
        .join(places, ["size", "h"])
        .groupBy(*KEY, "size", "item", "n_words")
        .agg(covered.alias("covered"))
        # tiles are made of seeds: what these don't cover, no tile does
        .where(F.size("covered") >= threshold * F.col("n_words"))
        .select(*KEY, "size", "item")
    )
    both = written(pairs, "pairs").join(found, [*KEY, "size"]).join(items.withColumnRenamed("grams", "item_grams"), ["item", "size"])
    both = both.select(*KEY, "item", "item_id", "n_words", "size", "pos", "grams", "item_grams")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("pos", pa.int64()), ("at", pa.int64()), ("words", pa.int64())]))
        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, len(whole), 256)):
            made = [
                tiles(p.values.to_numpy(), d.values.to_numpy(), i.values.to_numpy(), s)
                for p, d, i, s in zip(batch.column(6), batch.column(7), batch.column(8), batch.column(5).to_pylist())
            ]
            coverage = [sum(x[2] for x in t) / n for t, n in zip(made, batch.column(4).to_pylist())]
            as_rows = [[dict(zip(("pos", "at", "words"), x)) for x in t] for t in made]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(coverage, pa.float64()), pa.array(as_rows, kind)],
                names=[*KEY, "item", "item_id", "coverage", "tiles"],
            )

    schema = "key_a long, key_b long, item long, item_id long, coverage double, tiles array<struct<pos:long,at:long,words:long>>"
    return both.mapInArrow(handed_back(of), schema).where(F.col("coverage") >= threshold)


def _items(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    return items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))


def _keyed(doc_id: str, text: str) -> list[Column]:
    return [x.alias(k) for k, x in zip(KEY, row_key(F.col(doc_id), F.col(text).cast("string")))]


def contamination(
    docs: DataFrame,
    items: DataFrame,
    k: int = 4,
    threshold: float = 0.5,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(doc_id, contaminated, item_id, coverage, n_items), one row per row of `docs`.

    contaminated: tiles cover at least `threshold` of some item; item_id is the item covered most (the
    smallest id of equals), n_items how many there are; null, 0.0 and 0 elsewhere. Null texts hold no
    words. Rows that share a doc_id, or have none, are looked at each for itself; so are items that share
    an item_id or have none (item_id is then null). Empty tables of either kind contaminate nothing. Other
    columns aren't read.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    docs = docs.select("*", *_keyed("doc_id", "text"))
    found = (
        overlaps(docs, _items(items, item_id, item_text), k, threshold)
        .groupBy(*KEY)
        # ~ turns the order of ids around without leaving their range
        .agg(F.max(F.struct("coverage", F.col("item_id").isNotNull(), F.bitwise_not("item_id").alias("turned"))).alias("best"), F.count("*").alias("n_items"))
        .select(*KEY, F.bitwise_not(F.col("best.turned")).alias("item_id"), F.col("best.coverage").alias("coverage"), "n_items")
    )
    return docs.select("doc_id", *KEY).join(found, KEY, "left").select(
        "doc_id",
        F.col("n_items").isNotNull().alias("contaminated"),
        "item_id",
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
    )


def clean(docs: DataFrame, items: DataFrame, k: int = 4, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, that aren't contaminated (see `contamination`)."""
    a, b = fresh(docs.columns, *KEY)
    keyed = docs.select("*", *(x.alias(n) for n, x in zip((a, b), _keyed(doc_id, text))))
    texts = keyed.select(F.col(a).alias("key_a"), F.col(b).alias("key_b"), F.col(text).cast("string").alias("text"))
    found = overlaps(texts, _items(items, item_id, item_text), k, threshold).select(F.col("key_a").alias(a), F.col("key_b").alias(b)).distinct()
    return keyed.join(sized(written(found, "contaminated")), [a, b], "left_anti").select(*docs.columns)
