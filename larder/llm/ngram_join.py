"""Exact similarity join of texts on word n-grams.

Texts become sets of hashed shingles, in bands of similar size. Two sets that are similar enough share a
shingle among the first few of any fixed order (prefix filtering), so sets meet in tiles: those of
neighbouring bands that share such a shingle. In a tile, hashed bitmaps bound the overlap from above by
counting bits, and what passes is settled by intersecting the sorted arrays.

Groups of copies are never expanded. Equal sets are one from the start. In a tile each set is first tried
with the few that its bitmap is closest to, which joins any large group by a linear number of pairs; then
only pairs of different components are left to look at, and all of those are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.llm.common import Tables, bits_for, components, fresh, handed_back, is_marked, marked, row_key, sized, written
from larder.llm.textops import mix, shingle_sets, slices

#: Hashes that a task counts before it reports them.
_COUNTED = 1 << 20
#: Shingles with lower hashes are counted. A third of all: more than a prefix at similarity 0.75 takes.
_COUNTED_BELOW = np.uint64(2**64 // 3)
ROW = ["row_a", "row_b"]
SIGNATURES = "doc_id long, row_a long, row_b long, n_shingles long, key_a long, key_b long, bitmap binary, prefix array<long>"


def repeated_shingles(docs: DataFrame, k: int) -> DataFrame:
    """(h, n): shingles below _COUNTED_BELOW that more than one text holds, with how many do. Prefixes
    begin with low hashes, so these are the ones worth counting; counts are exact and over all texts."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def report() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n, pa.int64())], names=["h", "n"])

        for batch in batches:
            for part in slices(batch, 0):
                sets = [s[: np.searchsorted(s, _COUNTED_BELOW)] for s in shingle_sets(part.column(0), k)]
                held += sets
                size += sum(map(len, sets))
                if size >= _COUNTED:
                    yield report()
                    held, size = [], 0
        yield report()

    counts = docs.select("text").mapInArrow(handed_back(of), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return counts.where("n > 1")


def frequent(counts: DataFrame, often: int = 8, most: int = 1 << 19) -> np.ndarray:
    """Of the counted shingles that `often` texts hold, the `most` most frequent, rarest first. They only
    order shingles: results are the same with any list, good lists make tiles small."""
    top = counts.where(F.col("n") >= often).orderBy(F.desc("n"), "h").limit(most).toPandas()
    return top["h"].to_numpy(dtype=np.int64).view(np.uint64)[::-1].copy()


def _bitmap(s: np.ndarray) -> bytes:
    """One parity bit per slot. There are two to four slots per element (256 at least, 16,384 at most), a
    power of two, so that sets of one size band have one or two widths, and wider ones fold onto narrower."""
    width = min(max(256, 2 << int(len(s)).bit_length()), 1 << 14)
    slots = np.bincount((mix(s) & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits((slots & 1).astype(np.uint8), bitorder="little").tobytes()


def signatures(docs: DataFrame, k: int, percent: int, order: np.ndarray, repeated: np.ndarray) -> DataFrame:
    """SIGNATURES of every text: size of its set, a 128-bit key of it, bitmap, and its prefix without
    shingles that, by their counts, no other text holds."""
    ranks = docs.sparkSession.sparkContext.broadcast((np.sort(order), np.argsort(order)))  # `most` entries
    shared = docs.sparkSession.sparkContext.broadcast(repeated)  # as many bits as `bits_for` allows

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = ranks.value
        for batch in (part for whole in batches for part in slices(whole, 3)):
            sets = shingle_sets(batch.column(3), k)
            n = np.array([len(s) for s in sets], dtype=np.int64)
            keys = np.zeros((len(sets), 2), dtype=np.uint64)
            maps, prefixes = [], []
            for i, s in enumerate(sets):
                keys[i], whole_set = _keys(s), s
                # overlap >= ceil(percent * n / 100), so a partner holds one of the first n - that + 1
                length = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                # the order of all sets: counted and rare, counted and frequent by frequency, not counted
                low = np.searchsorted(s, _COUNTED_BELOW)
                if len(known) and low:
                    at = np.minimum(np.searchsorted(known, s[:low]), len(known) - 1)
                    often = known[at] == s[:low]
                    late = s[:low][often]
                    s = np.concatenate((s[:low][~often], late[np.argsort(rank[at[often]], kind="stable")], s[low:]))
                s = s[:length]
                prefixes.append(s[(s >= _COUNTED_BELOW) | is_marked(shared.value, s)])
                maps.append(_bitmap(whole_set) if len(prefixes[-1]) else b"")  # one that meets no other needs none
            sizes = np.array([len(p) for p in prefixes])
            flat = np.concatenate(prefixes).view(np.int64) if prefixes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    pa.array(n),
                    pa.array(keys[:, 0].view(np.int64)),
                    pa.array(keys[:, 1].view(np.int64)),
                    pa.array(maps, pa.binary()),
                    pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), pa.array(flat)),
                ],
                names=["doc_id", *ROW, "n_shingles", "key_a", "key_b", "bitmap", "prefix"],
            )

    return docs.select("doc_id", *ROW, "text").mapInArrow(handed_back(of), SIGNATURES)


def _keys(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    return mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)


def _folded(bitmaps: list[bytes], width: int) -> np.ndarray:
    """Bitmaps as rows of `width` bytes; wider ones are folded by exclusive or, which keeps parities."""
    out = np.zeros((len(bitmaps), width), dtype=np.uint8)
    for i, b in enumerate(bitmaps):
        x = np.frombuffer(b, np.uint8)
        out[i] = np.bitwise_xor.reduce(x.reshape(-1, width), axis=0) if len(x) > width else x
    return out.view(np.uint64)


def overlap_bounds(n_a: np.ndarray, bits_a: np.ndarray, n_b: np.ndarray, bits_b: np.ndarray) -> np.ndarray:
    """For each a and b an overlap that they don't exceed. A slot whose parities differ holds an element of
    one set alone, so n_a + n_b - 2 * overlap is at least the number of such slots."""
    apart = np.zeros((len(n_a), len(n_b)), dtype=np.int64)
    for w in range(bits_a.shape[1]):
        apart += np.bitwise_count(bits_a[:, w, None] ^ bits_b[None, :, w])
    both = n_a[:, None] + n_b[None, :]
    return np.minimum((both - apart) // 2, np.minimum(n_a[:, None], n_b[None, :]))


def _tile_pairs(x: pa.Table, y: pa.Table, percent: int, best: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of x and y (the same table, or two blocks) that bitmaps leave possible. With `best`,
    for each row at most so many, those of the largest bounds; else all of different parts."""
    n_x, n_y = (t.column("n").to_numpy() for t in (x, y))
    part_x, part_y = (t.column("part").to_numpy() for t in (x, y))
    ids_x, ids_y = (t.column("doc").to_numpy() for t in (x, y))
    if best is None and (part_x == part_x[0]).all() and (part_y == part_x[0]).all():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    maps_x, maps_y = (t.column("bitmap").to_pylist() for t in (x, y))
    out_a, out_b = [], []
    # rows come by size: for a band of them, those that they can link with are one stretch of y
    for at in range(0, len(n_x), 64):
        rows = slice(at, min(at + 64, len(n_x)))
        low = int(np.searchsorted(n_y, -(-percent * n_x[rows][0] // 100)))
        high = int(np.searchsorted(n_y, 100 * n_x[rows][-1] // percent, side="right"))
        for left in range(low, high, 2048):
            right = min(left + 2048, high)
            width = min(min(map(len, maps_x[rows])), min(map(len, maps_y[left:right])))
            bound = overlap_bounds(n_x[rows], _folded(maps_x[rows], width), n_y[left:right], _folded(maps_y[left:right], width))
            good = 100 * bound >= percent * (n_x[rows][:, None] + n_y[None, left:right] - bound)
            good &= ids_x[rows][:, None] != ids_y[None, left:right]
            if best is None:
                good &= part_x[rows][:, None] != part_y[None, left:right]
                if x is y:
                    good &= ids_x[rows][:, None] < ids_y[None, left:right]
            i, j = np.nonzero(good)
            if best is not None and len(i):
                order = np.lexsort((-bound[i, j], i))
                first = np.searchsorted(i[order], i[order])
                order = order[np.arange(len(order)) - first < best]
                i, j = i[order], j[order]
            out_a.append(ids_x[rows][i])
            out_b.append(ids_y[left:right][j])
    a, b = (np.concatenate([*o, np.zeros(0, np.int64)]).astype(np.int64) for o in (out_a, out_b))
    return np.minimum(a, b), np.maximum(a, b)


def _possible(blocks: DataFrame, percent: int, best: int | None) -> DataFrame:
    """Pairs (a, b) of all tiles. blocks: (head, low, high, block, doc, n, bitmap, part); a group (head,
    low, high) has the rows of one block, or of two, and goes to one task, which holds one at a time."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(group: pa.Table) -> pa.RecordBatch:
            number = group.column("block").to_numpy()
            x = group.filter(pa.array(number == number.min())).combine_chunks()
            y = x if number.min() == number.max() else group.filter(pa.array(number == number.max())).combine_chunks()
            a, b = _tile_pairs(x, y, percent, best)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held: list[pa.Table] = []
        key = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = np.column_stack([table.column(c).to_numpy() for c in ("head", "low", "high")])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
            for s, e in zip(cuts, cuts[1:]):
                if e == s:
                    continue
                if key is not None and tuple(keys[s]) != key:
                    yield pairs(pa.concat_tables(held))
                    held = []
                key = tuple(keys[s])
                held.append(table.slice(s, e - s))
        if held:
            yield pairs(pa.concat_tables(held))

    placed = blocks.repartition("head", "low", "high").sortWithinPartitions("head", "low", "high", "block", "n", "doc")
    return placed.mapInArrow(handed_back(of), "a long, b long").distinct()


def verified(pairs: DataFrame, heads: DataFrame, docs: DataFrame, k: int, percent: int, alike: bool, tables: Tables) -> DataFrame:
    """Those of `pairs` (a, b) of classes that are similar enough, by intersecting their sets as sorted
    arrays. heads: (class, row_a, row_b), the row of `docs` that stands for each class; alike: whether rows
    of `docs` share a key, which are then alike in id and text.

    Texts of the rows that some pair asks for go to their pairs, compressed, at a third of their sets'
    size; a bitmap tells nearly all others where they are read. The links are written, and what they were
    made from is freed.
    """
    asked = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(heads, "class")
    asked = tables.put(asked, "asked")
    shared = docs.sparkSession.sparkContext.broadcast(marked(asked.select("row_a"), bits_for(asked.count())))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(is_marked(shared.value, batch.column(0).to_numpy())))
            packed = [zlib.compress(t.as_buffer(), 1) if t.is_valid else zlib.compress(b"") for t in some.column(2)]
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(packed, pa.binary())], names=[*ROW, "packed"])

    texts = docs.select(*ROW, "text").mapInArrow(handed_back(of), "row_a long, row_b long, packed binary")
    texts = texts.join(sized(asked), ROW).select("class", "packed")
    texts = tables.put(texts.dropDuplicates(["class"]) if alike else texts, "texts")
    side = lambda x: texts.select(F.col("class").alias(x), F.col("packed").alias(f"text_{x}"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 128) for whole in batches for at in range(0, len(whole), 128)):
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            own = dict(zip([*a, *b], [*batch.column(2), *batch.column(3)]))
            column = pa.array([zlib.decompress(t.as_buffer()) for t in own.values()], pa.binary()).cast(pa.string())
            sets = dict(zip(own, shingle_sets(column, k)))
            good = []
            for x, y in zip(a, b):
                x, y = sorted((sets[x], sets[y]), key=len)
                overlap = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)) if len(x) else 0
                good.append(overlap > 0 and 100 * overlap >= percent * (len(x) + len(y) - overlap))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    links = tables.put(both.mapInArrow(handed_back(settle), "a long, b long").distinct(), "links")
    tables.drop("asked", "texts")
    return links


def row_components(docs: DataFrame, k: int = 5, percent: int = 75, tile_rows: int = 4096, best: int = 2) -> DataFrame:
    """(doc_id, row_a, row_b, n_shingles, component): a row per row of `docs` (doc_id, text, row_a, row_b).

    Rows are told apart by their key, which is made of id and text; equal components are linked. A row
    whose set is empty has no component.
    """
    tables = Tables(docs.sparkSession)
    counts = tables.put(repeated_shingles(docs, k), "counts")
    order, repeated = frequent(counts), marked(counts.select("h"), bits_for(counts.count()))
    sigs = tables.put(signatures(docs, k, percent, order, repeated), "signatures")
    tables.drop("counts")

    alike = not sigs.groupBy(*ROW).agg(F.count("*").alias("n")).where("n > 1").isEmpty()

    # Equal sets: one class, numbered, with the row that stands for it.
    keys = ["n_shingles", "key_a", "key_b"]
    heads = sigs.where("n_shingles > 0").dropDuplicates(keys).withColumn("class", F.monotonically_increasing_id())
    heads = tables.put(heads.drop("doc_id"), "heads")
    own = tables.put(sigs.select("doc_id", *ROW, *keys), "row-keys")
    tables.drop("signatures")

    # Tiles: sets that share a shingle of their prefixes. Shingles become one tile if the smallest of
    # their sets is the same by number and by hash, so likely only if they have much the same sets: those
    # of a group of near copies make a few tiles in all, unrelated ones of one set stay apart.
    # All is counted before it is joined back, from stored tables: a join that Spark may split where one
    # shingle or one group holds a large part of all rows.
    tokens = heads.select(F.explode("prefix").alias("token"), F.col("class").alias("doc"))
    met = tokens.groupBy("token").agg(F.count("*").alias("size"), F.xxhash64(F.min("doc"), F.min(F.xxhash64("doc"))).alias("head"))
    met = tables.put(met.where("size > 1").select("token", "head"), "tokens")
    sized = heads.select(F.col("class").alias("doc"), F.col("n_shingles").alias("n"))
    tiles = tables.put(tokens.join(met, "token").select("head", "doc").distinct().join(sized, "doc"), "tiles")
    tables.drop("tokens")
    heads = tables.put(heads.select("class", *ROW, *keys, "bitmap"), "names")  # prefixes have been used
    tables.drop("heads")
    # Large tiles are cut into blocks by size of set: a running sum over the sizes of a tile says where
    # each begins, a hash spreads those of one size.
    sizes = tiles.groupBy("head", "n").agg(F.count("*").alias("same"))
    before = F.sum("same").over(Window.partitionBy("head").orderBy("n")) - F.col("same")
    sizes = tables.put(sizes.withColumn("before", before), "sizes")
    place = F.col("before") + F.pmod(F.xxhash64("doc"), F.col("same"))
    rows = tiles.join(sizes, ["head", "n"]).select("head", "doc", "n", F.floor(place / tile_rows).cast("int").alias("block"))
    rows = tables.put(rows, "rows")
    tables.drop("tiles", "sizes")
    bitmaps = heads.select(F.col("class").alias("doc"), "bitmap")
    named = heads.select("class", *ROW)

    def blocks(rows: DataFrame, first: bool) -> DataFrame:
        """Groups of one block, or of two that sizes allow to link: neighbours for a start, then all but
        those that one component has to itself."""
        cuts = rows.groupBy("head", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("part").alias("p"), F.max("part").alias("q"))
        x, y = (cuts.select("head", *(F.col(c).alias(f"{c}_{s}") for c in ("block", "least", "most", "p", "q"))) for s in "xy")
        open_ = "block_y - block_x <= 1" if first else "least(p_x, p_y) < greatest(q_x, q_y)"
        pairs = x.join(y, "head").where(f"block_x <= block_y and 100 * most_x >= {percent} * least_y and {open_}")
        pairs = pairs.select("head", F.col("block_x").alias("low"), F.col("block_y").alias("high"))
        pairs = tables.put(pairs.withColumn("block", F.explode(F.array_distinct(F.array("low", "high")))), "blocks")
        placed = rows.join(pairs, ["head", "block"]).join(bitmaps, "doc")
        return placed.select("head", "low", "high", "block", "doc", "n", "bitmap", "part")

    first = tables.put(_possible(blocks(rows.withColumn("part", F.col("doc")), True), percent, best), "first")
    tables.drop("blocks")
    links = verified(first, named, docs, k, percent, alike, tables)
    # All other pairs of a tile, unless they are in one component by now. Of a tile in which no set has more
    # than `best` others, all possible pairs have been looked at.
    parts = tables.put(components(links).select(F.col("node").alias("doc"), F.col("component").alias("part")), "parts")
    open_ = tables.put(rows.join(parts, "doc", "left").withColumn("part", F.coalesce("part", "doc")), "parted")
    tables.drop("rows", "links")
    several = open_.groupBy("head").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("n"))
    several = several.where(f"p < q and n > {min(best + 1, tile_rows)}").select("head")
    open_ = tables.put(open_.join(tables.put(several, "several"), "head", "left_semi"), "open")
    tables.drop("parted", "several")
    rest = tables.put(_possible(blocks(open_, False), percent, None).join(first, ["a", "b"], "left_anti"), "rest")
    tables.drop("first", "open", "blocks")
    links = verified(rest, named, docs, k, percent, alike, tables)
    # Links that were found last join components, not single sets.
    part = lambda x: parts.select(F.col("doc").alias(x), F.col("part").alias(f"part_{x}"))
    joined = links.join(part("a"), "a", "left").join(part("b"), "b", "left")
    joined = components(joined.select(F.coalesce("part_a", "a").alias("a"), F.coalesce("part_b", "b").alias("b")))
    joined = joined.withColumnsRenamed({"node": "part", "component": "whole"})
    classes = heads.select(*keys, "class").join(parts.withColumnRenamed("doc", "class"), "class", "left")
    classes = classes.withColumn("part", F.coalesce("part", "class")).join(joined, "part", "left")
    classes = tables.put(classes.select(*keys, F.coalesce("whole", "part").alias("component")), "classes")
    tables.drop("names", "parts", "rest", "links")
    return own.join(classes, keys, "left").select("doc_id", *ROW, "n_shingles", "component")


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return docs.withColumns(dict(zip(ROW, row_key("doc_id", "text"))))


def ngram_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row per row of `docs`.

    A text's set holds its distinct k-word shingles (k = 5); A-Z are taken as a-z, words end at ASCII white
    space. A text of fewer words is one shingle; a null or blank text has an empty set and links with
    nothing. Two texts link when 100 * intersection >= percent * union (percent = 75). component_id is the
    smallest doc_id that links lead to, its own included.

    Rows that share a doc_id, or have none, link each for itself; a component of rows without an id has
    no component_id. An empty table gives an empty table. Other columns aren't read.
    """
    found = written(row_components(_rows(docs, doc_id, text), **options), "rows")
    least = written(found.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least")), "least")
    return found.join(least, "component", "left").select(
        "doc_id", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id")
    )


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Rows of `docs`, with all their columns: of each component the one with the smallest id (those
    without an id last; of equals the smallest key). Of rows alike in id and text that would stay one does,
    chosen by a hash of all columns. Rows whose set is empty all stay."""
    a, b = fresh(docs.columns, *ROW)
    found = written(row_components(_rows(docs, doc_id, text), **options).where("component is not null"), "rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", *ROW)).alias("first")
    kept = written(found.groupBy("component").agg(first, F.count("*").alias("n")).where("n > 1"), "kept")
    gone = found.join(kept, "component").where("row_a <> first.row_a or row_b <> first.row_b")
    gone = sized(written(gone.select(F.col("row_a").alias(a), F.col("row_b").alias(b)).distinct(), "gone"))
    keyed = docs.withColumns(dict(zip((a, b), row_key(F.col(doc_id).cast("long"), F.col(text).cast("string"))))).join(gone, [a, b], "left_anti")
    several = found.select(F.col("row_a").alias(a), F.col("row_b").alias(b)).groupBy(a, b).agg(F.count("*").alias("n")).where("n > 1").select(a, b)
    several = written(several, "several")
    if several.isEmpty():
        return keyed.select(*docs.columns)
    (row,) = fresh([*docs.columns, a, b], "row")
    alike = keyed.join(several, [a, b], "left_semi").groupBy(a, b).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias(row))
    return keyed.join(several, [a, b], "left_anti").select(*docs.columns).unionAll(alike.select(*(F.col(row)[c].alias(c) for c in docs.columns)))
