"""Exact vector retrieval with optional reranking (V1-V9)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructType

from larder.functions.numbers import clamped
from larder.operators.paging import top
from larder.sources.scratch import Scratch, small

HITS = "query_id long, item_id long, similarity double"
_CELLS = 64


def top_k(
    queries: DataFrame, index: DataFrame, k: int = 5, threshold: float = 0.35, candidates: bool = False, cell_items: int = 4096, block_queries: int = 32_768, block_items: int = 32_768
) -> DataFrame:
    """HITS: for each query the k most similar items of at least `threshold`.

    queries: (query_id, vector, candidate_ids array if `candidates`), index: (item_id, label, vector). The
    query is brought to length 1, the index isn't. A query with a list of candidates sees only items with
    these labels; an empty list sees all. Ties go to the smaller item id. Vectors that are null or hold nulls
    find nothing and aren't found; vectors meet those of their own length.

    Both sides are dealt into cells, those near one pivot (one for each `cell_items` items, 64 at most), and
    cells into blocks of bounded size; where cells leave out less than half of the products and copy more rows
    than blocks alone would, all are one cell. Queries and items of a pair of cells meet, unless pivots, radii and
    norms say that no product can reach the threshold: a pair of blocks in a task, which returns k hits a
    query. Items are copied once for each block of queries that they may serve, queries once for each such
    block of items, in single precision if both sides are; neither side goes through the driver. Products are
    of the query as given, summed in the order of components and then divided by its length, so that equal
    vectors have equal similarities.
    """
    columns = ["query_id", "vector", *(["candidate_ids"] if candidates else [])]
    whole = lambda c: F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull())
    single = ArrayType(FloatType())
    kind = "array<float>" if all(df.schema["vector"].dataType.simpleString() == single.simpleString() for df in (queries, index)) else "array<double>"
    q = queries.where(whole("vector")).select("query_id", F.col("vector").cast(kind).alias("vector"), *columns[2:])
    i = index.where(whole("vector")).select("item_id", "label", F.col("vector").cast(kind).alias("vector"))
    scratch = Scratch(index.sparkSession)
    n = i.count()
    pivots = [r["vector"] for r in i.orderBy(F.xxhash64("vector"), "vector").select("vector").limit(min(_CELLS, -(-n // cell_items))).collect()]  # 64 at most
    cells = _Cells(pivots)
    q, i = scratch.put(cells.assigned(q, of_length_1=True), "queries"), scratch.put(cells.assigned(i), "items")
    pairs, useful = cells.pairs(q, i, threshold, block_queries, block_items)
    if not useful:
        q, i = q.withColumn("cell", F.lit(0)), i.withColumn("cell", F.lit(0))
        pairs = pairs.select("dim", F.lit(0).alias("q_cell"), F.lit(0).alias("i_cell")).distinct()
    q = _blocks(q, "q", block_queries, "query_id", scratch).join(F.broadcast(pairs), ["dim", "q_cell"])  # pairs of cells, 4,096 a dimension at most
    i = _blocks(i, "i", block_items, "item_id", scratch).join(F.broadcast(pairs), ["dim", "i_cell"])
    # a query goes to each block of its partners' items, an item to each block of their queries
    key = ["dim", "q_cell", "i_cell", "q_block", "i_block"]
    parts = lambda df, side: df.groupBy("dim", f"{side}_cell").agg(F.max(f"{side}_blocks").alias(f"{side}_blocks"))
    n_q, n_i = scratch.put(parts(q, "q"), "q-blocks"), scratch.put(parts(i, "i"), "i-blocks")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = q.drop("q_blocks").join(small(n_i), ["dim", "i_cell"]).withColumn("i_block", each("i_blocks"))
    i = i.drop("i_blocks").join(small(n_q), ["dim", "q_cell"]).withColumn("q_block", each("q_blocks"))
    label = index.schema["label"].dataType
    nothing, no_list = F.lit(None).cast(label).alias("label"), F.lit(None).cast(ArrayType(label)).alias("wanted")
    wanted = F.col("candidate_ids").cast(ArrayType(label)).alias("wanted") if candidates else no_list
    q = q.select(*key, F.lit(True).alias("asks"), F.col("query_id").cast("long").alias("id"), nothing, wanted, "vector")
    i = i.select(*key, F.lit(False).alias("asks"), F.col("item_id").cast("long").alias("id"), "label", no_list, "vector")
    both = q.unionByName(i)
    hits = both.groupBy(*key).applyInArrow(lambda table: _hits(table, k, threshold), HITS)
    return top(hits, k, ["query_id"], [F.desc("similarity"), F.col("item_id")])


class _Cells:
    """Cells of vectors by their nearest pivot; vectors of another length than the pivots' are one cell."""

    def __init__(self, pivots: list[list[float]]):
        dims = [len(p) for p in pivots]
        self.dim = max(dims, key=dims.count, default=0)
        self.pivots = np.array(list(dict.fromkeys(tuple(p) for p in pivots if len(p) == self.dim)), dtype=np.float64).reshape(-1, self.dim)

    def assigned(self, df: DataFrame, of_length_1: bool = False) -> DataFrame:
        """`df` with dim, cell, far (from the pivot) and norm, of its vectors brought to length 1 or as they are."""
        pivots, dim = self.pivots, self.dim

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column("vector")
                n = lists.value_lengths().to_numpy(zero_copy_only=False)
                cell, far, norm = np.zeros(len(batch), np.int32), np.zeros(len(batch)), np.zeros(len(batch))
                own = np.flatnonzero(n == dim) if len(pivots) and dim else np.zeros(0, np.int64)
                if len(own):
                    x = lists.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), dim).astype(np.float64)
                    if of_length_1:
                        length = np.linalg.norm(x, axis=1)
                        x = x / np.where(length <= 1e-12, 1.0, length)[:, None]
                    square = (x * x).sum(axis=1)
                    d = square[:, None] + (pivots * pivots).sum(axis=1) - 2 * (x @ pivots.T)
                    cell[own] = d.argmin(axis=1)
                    far[own], norm[own] = np.linalg.norm(x - pivots[cell[own]], axis=1), np.sqrt(square)
                columns = [pa.array(n.astype(np.int32)), pa.array(cell), pa.array(far), pa.array(norm)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "dim", "cell", "far", "norm"])

        schema = StructType([*df.schema.fields, *StructType.fromDDL("dim int, cell int, far double, norm double").fields])
        return df.mapInArrow(of, schema)

    def pairs(self, q: DataFrame, i: DataFrame, threshold: float, block_queries: int, block_items: int) -> tuple[DataFrame, bool]:
        """(dim, q_cell, i_cell) whose members' products may reach `threshold`, and whether cells save half of the
        products, or copies. A query is p + a, an item r + b,
        |a| and |b| at most the cells' radii: their product is at most p.r + |a||r| + |b||p| + |a||b|, and at
        most |p + a||r + b|."""
        known = lambda df: {(r["dim"], r["cell"]): r for r in df.groupBy("dim", "cell").agg(F.max("far").alias("far"), F.max("norm").alias("norm"), F.count("*").alias("n")).collect()}
        of_q, of_i = known(q), known(i)
        out = []
        for (d, c), x in of_q.items():
            for (e, b), y in of_i.items():
                if d != e:
                    continue
                most = np.inf
                if d == self.dim and len(self.pivots):
                    p, r = self.pivots[c], self.pivots[b]
                    most = min(p @ r + x["far"] * np.linalg.norm(r) + y["far"] * np.linalg.norm(p) + x["far"] * y["far"], x["norm"] * y["norm"])
                if not most * (1 + 1e-9) + 1e-9 < threshold:
                    out.append((d, c, b))
        cost = lambda n, m: np.array((n * m, m * -(-n // block_queries) + n * -(-m // block_items)))
        total = lambda of, d: sum(x["n"] for (e, _), x in of.items() if e == d)
        with_cells = sum((cost(of_q[d, c]["n"], of_i[d, b]["n"]) for d, c, b in out), np.zeros(2))
        without = sum((cost(total(of_q, d), total(of_i, d)) for d in {d for d, _, _ in out}), np.zeros(2))
        useful = with_cells[0] <= without[0] / 2 or with_cells[1] <= without[1]
        return q.sparkSession.createDataFrame(out, "dim int, q_cell int, i_cell int"), bool(useful)


def _blocks(df: DataFrame, side: str, rows: int, key: str, scratch: Scratch) -> DataFrame:
    """`df` with <side>_cell, <side>_block and <side>_blocks: blocks of some `rows` rows of a cell."""
    n = df.groupBy("dim", "cell").agg(F.ceil(F.count("*") / rows).cast("int").alias(f"{side}_blocks"))
    out = df.drop("far", "norm").join(small(scratch.put(n, f"{side}-sizes")), ["dim", "cell"]).withColumnRenamed("cell", f"{side}_cell")
    return out.withColumn(f"{side}_block", F.pmod(F.xxhash64(key), f"{side}_blocks").cast("int"))


def _dots(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of rows i of x with rows j of y, summed in the order of components, wherever the rows lie."""
    out = np.zeros(len(i))
    for d in range(x.shape[1]):
        out += x[i, d] * y[j, d]
    return out


def _hits(table: pa.Table, k: int, threshold: float) -> pa.Table:
    """The first k items of each query of one pair of blocks."""
    asks = table.column("asks").to_numpy(zero_copy_only=False)
    a, b = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
    none = np.zeros(0, np.int64)
    query, item, similar = none, none, np.zeros(0)
    if len(a) and len(b):
        dim = table.column("dim")[0].as_py()
        x, y = (t.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), dim).astype(np.float64) for t in (a, b))
        ids, labels, wanted = b.column("id").to_numpy(), b.column("label").to_numpy(), a.column("wanted").to_pylist()
        length = np.sqrt(_dots(x, x, np.arange(len(a)), np.arange(len(a))))
        length = np.where(length <= 1e-12, 1.0, length)
        unit, far = x / length[:, None], np.linalg.norm(y, axis=1)
        slack = 1e-14 * (dim + 8) * far[np.isfinite(far)].max(initial=0.0)  # more than products differ by in another order of sums
        bar = np.full(len(a), threshold)
        size = max(64, (1 << 23) // len(a))
        for at in range(0, len(b), size):
            s = unit @ y[at : at + size].T
            if not np.isfinite(s).all():
                s[np.isnan(s)] = -np.inf
            for j, some in enumerate(wanted):
                if some:
                    s[j, ~np.isin(labels[at : at + size], some)] = -np.inf
            low = bar
            if s.shape[1] > k and np.count_nonzero(s >= bar[:, None]) > 4 * k * len(a):  # the k-th of these is a bar too
                low = np.maximum(bar, np.partition(s, s.shape[1] - k, axis=1)[:, -k])
            i, j = np.nonzero((s >= low[:, None] - slack) & (s > -np.inf))
            exact = _dots(x, y, i, j + at) / length[i]
            i, j, exact = (c[exact >= bar[i]] for c in (i, j, exact))
            query, item, similar = np.concatenate((query, i)), np.concatenate((item, j + at)), np.concatenate((similar, exact))
            order = np.lexsort((ids[item], -similar, query))
            start = np.maximum.accumulate(np.where(np.diff(query[order], prepend=-1) != 0, np.arange(len(order)), 0)) if len(order) else order
            kept = order[np.arange(len(order)) - start < k]
            query, item, similar = query[kept], item[kept], similar[kept]
            full = np.flatnonzero(np.bincount(query, minlength=len(a)) == k)
            least = np.full(len(a), np.inf)
            np.minimum.at(least, query, similar)
            bar[full] = np.maximum(bar[full], least[full])
        item = ids[item]
        query = a.column("id").to_numpy()[query]
    return pa.table({"query_id": query, "item_id": item, "similarity": similar})


def reranked(hits: DataFrame, scorer: Callable[[Column, Column], Column] | None, n: int = 5) -> DataFrame:
    """The first n hits with rerank scores, clamped to 0..1, best first; a missing score is 0. Without a
    scorer hits stay as they are, with null scores (V2)."""
    if scorer is None:
        return hits.withColumn("score", F.lit(None).cast("double"))
    first = top(hits, n, ["query_id"], [F.desc("similarity"), F.col("item_id")])
    return first.withColumn("score", clamped(F.coalesce(scorer(F.col("query_id"), F.col("item_id")), F.lit(0.0))))


def accepted(hits: DataFrame, by_score: float = 0.5, by_similarity: float = 0.35) -> DataFrame:
    """The best hit of each query if it is good enough, with its confidence (V3)."""
    value = F.coalesce("score", "similarity")
    best = top(hits, 1, ["query_id"], [value.desc(), F.desc("similarity"), F.col("item_id")])
    good = F.when(F.col("score").isNotNull(), F.col("score") >= by_score).otherwise(F.col("similarity") >= by_similarity)
    return best.where(good).withColumn("confidence", clamped(value))


def recognised(images: DataFrame, regions: DataFrame, index: DataFrame, embed: Callable[[bytes], np.ndarray], scorer: Callable[[Column, Column], Column] | None = None, k: int = 5, threshold: float = 0.35, by_score: float = 0.5) -> DataFrame:
    """(image_id, region, item_id, label, confidence): from images to what is on them (V4, V9).

    A row per region (the whole image where it has none) is embedded, its k nearest items are found,
    reranked and accepted, and of a label that several regions of an image show the surest stays. images:
    (image_id, data), regions: (image_id, region, data), index as for `top_k`.
    """
    parts = regions_or_whole(images.withColumnRenamed("data", "whole"), regions)
    parts = parts.select("image_id", F.coalesce("region", F.lit(0)).alias("region"), F.coalesce("data", "whole").alias("data"))
    parts = parts.withColumn("query_id", F.xxhash64("image_id", "region"))
    vectors = embedded(parts, embed, key="query_id").where("status = 'ready'")
    hits = top_k(vectors.select(F.col("item_id").alias("query_id"), "vector"), index, k, threshold)
    best = accepted(reranked(hits, scorer, k), by_score, threshold)
    found = best.join(index.select("item_id", "label"), "item_id").join(parts.select("query_id", "image_id", "region"), "query_id")
    return top(found, 1, ["image_id", "label"], [F.desc("confidence"), F.col("region")]).select("image_id", "region", "item_id", "label", "confidence")


def regions_or_whole(images: DataFrame, regions: DataFrame, key: str = "image_id") -> DataFrame:
    """A row per region; images without any come once, with a null region, to be taken whole (V7)."""
    return images.join(regions, key, "left")


def embedded(samples: DataFrame, embed: Callable[[bytes], np.ndarray], key: str = "item_id", data: str = "data") -> DataFrame:
    """(item_id, vector, status, error): each sample's vector at length 1; one that fails is recorded and
    the others go on (V5)."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for item, value in zip(pdf["item_id"], pdf["data"]):
                try:
                    v = np.asarray(embed(value), dtype=np.float64)
                    n = np.linalg.norm(v)
                    rows.append((item, (v / n if n > 1e-12 else v).tolist(), "ready", None))
                except Exception as e:  # noqa: BLE001  what a model raises is unknown
                    rows.append((item, None, "failed", f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=["item_id", "vector", "status", "error"])

    return samples.select(F.col(key).alias("item_id"), F.col(data).alias("data")).mapInPandas(of, "item_id long, vector array<double>, status string, error string")
