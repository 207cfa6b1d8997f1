"""Hard negatives by a distributed nearest-neighbour join over Voronoi cells.

A component more, sqrt(M^2 - |x|^2) for a candidate and 0 for an anchor, M being the largest length, turns inner products into distances:
|q - x|^2 = |q|^2 + M^2 - 2 q.x, so the highest score is the nearest neighbour. Candidates go to the cell of their nearest pivot, and
a cell is known by its pivot and the range of distances from it, one row of numbers. For each anchor these
bounds say which cells can hold what it looks for; a cell is copied only to groups of anchors some of whom
it might serve, and each group is then joined exactly, in slices that merge by rank.

Two joins of this kind run one after the other: an anchor's positives are its nearest others of the same
label, and their scores give the range that its negatives must lie in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from larder.llm.common import sized, written

_BLOCK = 4096
_FAR = float("inf")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(lists)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of x to all of y, never less than 0."""
    square = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T)
    return np.sqrt(np.maximum(square, 0))


def _lifted(v: np.ndarray, longest: float, query: bool) -> np.ndarray:
    rest = np.zeros(len(v)) if query else np.sqrt(np.maximum(longest - (v * v).sum(axis=1), 0))
    return np.hstack((v, rest[:, None]))


def cell_bounds(far: np.ndarray, apart: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) distance from each query to what a cell can hold. far: of queries to pivots; apart: of
    pivots to one another; low, high: distances of a cell's members to its pivot.

    Least: by the triangle inequality inside and outside of the cell's ring, and by the plane between its
    pivot and the query's nearest one, beyond which its members lie. Both are widened by more than what
    rounding can have added.
    """
    own = far.argmin(axis=1)
    near = far[np.arange(len(far)), own][:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = np.where(apart[own] > 0, (far * far - near * near) / (2 * apart[own]), 0)
    room = 1e-6 * (1 + far.max(initial=0) + high.max(initial=0))
    least = np.maximum(np.maximum(far - high, low - far), plane) - room
    return np.maximum(least, 0), far + high + room


def _first(k: int, owner: np.ndarray, score: np.ndarray, item: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Places of the first k of each owner: by score from above, then item, then row."""
    order = np.lexsort((row, item, -score, owner))
    owner = owner[order]
    start = np.maximum.accumulate(np.where(np.diff(owner, prepend=-1) != 0, np.arange(len(owner)), 0))
    return order[np.arange(len(owner)) - start < k]


def best_in_windows(
    score: Callable[[slice], np.ndarray], n: int, items: np.ndarray, rows: np.ndarray, allowed: Callable[[slice], np.ndarray],
    owners: np.ndarray, low: np.ndarray, high: np.ndarray, k: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place, score) of the first k of n candidates for each query, whose score lies in [low, high].

    A query belongs to an anchor, `owners`; score(slice) are all anchors' scores of some candidates, and
    allowed(slice) says which may be taken. Blocks grow from small ones, so that a bar for each query is
    found before much is looked at: below its k-th best nothing is kept.
    """
    query, place, value = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    bar = low.astype(np.float64).copy()
    at, size, most = 0, 64, max(64, min(_BLOCK, (1 << 22) // max(1, int(owners.max(initial=0)) + 1)))
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    waiting = 0
    while at < n:
        part = slice(at, min(at + size, n))
        s = np.where(allowed(part), score(part), -_FAR)
        for left in range(0, len(owners), 1024):
            some = np.arange(left, min(left + 1024, len(owners)))
            seen = s[owners[some]]
            i, j = np.nonzero((seen >= bar[some][:, None]) & (seen <= high[some][:, None]) & (seen > -_FAR))
            held.append((some[i], j + at, seen[i, j]))
            waiting += len(i)
        at, size = part.stop, min(size * 2, most)
        if waiting > 4096 + len(query) // 4 or at >= n:
            query, place, value = (np.concatenate((x, *more)) for x, more in zip((query, place, value), zip(*held)))
            kept = _first(k, query, value, items[place], rows[place])
            query, place, value, held, waiting = query[kept], place[kept], value[kept], [], 0
            lowest = np.full(len(owners), _FAR)
            np.minimum.at(lowest, query, value)
            full = np.flatnonzero(np.bincount(query, minlength=len(owners)) == k)
            bar[full] = np.maximum(bar[full], lowest[full])
    return query, place, value


def _groups(counts: dict[int, int], most: int, least_groups: int) -> dict[int, tuple[int, int]]:
    """(first group, number of groups) for the anchors of each cell: cells are taken in turn into groups of
    about equal size, `most` anchors at most; a larger cell gets several, which its anchors share by hash."""
    total = sum(counts.values())
    room = max(1, min(most, -(-total // max(1, least_groups))))
    out, number, filled = {}, 0, 0
    for cell in sorted(counts):
        n = counts[cell]
        if filled and filled + n > room:
            number, filled = number + 1, 0
        parts = -(-n // room)
        out[cell] = number, parts
        if parts > 1:
            number, filled = number + parts, 0
        else:
            filled += n
    return out


class _Cells:
    """What is known of all candidates' cells; its size is bounded by the number of pivots."""

    def __init__(self, rows: DataFrame, pivots: int, longest: float):
        # the different ones of some rows; which they are decides how much is skipped, not what is found
        first = rows.orderBy(F.xxhash64("id"), "id", "v").select("v").limit(4 * pivots).collect()
        self.longest = longest
        self.pivots = _lifted(np.array(list(dict.fromkeys(tuple(r["v"]) for r in first))[:pivots]), longest, query=False)
        self.apart = _distances(self.pivots, self.pivots)

    def assigned(self, rows: DataFrame, query: bool = False) -> DataFrame:
        """`rows` with cell int and far double, the distance to its pivot."""
        pivots, longest = self.pivots, self.longest

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d = _distances(_lifted(_matrix(batch.column("v")), longest, query), pivots)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=[*batch.schema.names, "cell", "far"])

        return rows.mapInArrow(of, T.StructType(list(rows.schema.fields)).add("cell", "integer").add("far", "double"))

    def measure(self, candidates: DataFrame) -> None:
        n = len(self.pivots)
        self.count, self.low, self.high = np.zeros(n, np.int64), np.full(n, _FAR), np.full(n, -_FAR)
        for r in candidates.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).collect():
            self.count[r["cell"]], self.low[r["cell"]], self.high[r["cell"]] = r["n"], r["low"], r["high"]


def hard_negatives(
    rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    pivots: int = 64, group_anchors: int = 32_768, slice_rows: int = 65_536, least_groups: int = 8,
    vec_id: str = "vec_id", vector: str = "vector", label: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A score is an inner product; higher ones come first, of equals the smaller id. For each row for which
    `anchor` holds, its positives are the first `positives` other rows of the same label, and for each of
    these the first `negatives` rows of another label with low * p <= 100 * score <= high * p are
    returned, p being the positive's score; fewer, or none, where there aren't as many. Rows take no part
    whose id, label or vector is null, or whose vector is empty, holds null or non-finite components or
    isn't as long as most are.

    Rows are told apart as they stand: rows that repeat, or share an id, are each others' positives, and an
    anchor that stands there twice is answered twice. Scores are exact where components are integers and
    no product of vectors reaches 2^46, as they must be for `low` and `high` to cut where they should;
    beyond, they are rounded as doubles are. An empty table gives an empty table, as does one without anchors. Other columns aren't read.
    """
    v = F.col(vector).cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(_FAR))
    good = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & (F.size(vector) > 0) & F.forall(v, fine)
    whole = rows.where(good).select(F.col(vec_id).cast("long").alias("id"), F.col(label).alias("label"), v.alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    sizes = whole.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("longest"))
    top = sizes.orderBy(F.desc("rows"), "n").first()
    none = rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score double, negative_score double")
    if top is None:
        return none
    whole = whole.where(F.size("v") == top["n"])
    cells = _Cells(whole, pivots, top["longest"] * (1 + 1e-9))
    candidates = written(cells.assigned(whole.withColumn("row", F.monotonically_increasing_id())), "cells")
    cells.measure(candidates)
    anchors = cells.assigned(candidates.where("anchor").drop("anchor", "cell", "far"), query=True).drop("far")
    counts = {r["cell"]: r["count"] for r in anchors.groupBy("cell").count().collect()}
    if not counts:
        return none
    of = _groups(counts, group_anchors, least_groups)
    first, parts = (F.create_map(*[F.lit(x) for c, g in of.items() for x in (c, g[i])])[F.col("cell")] for i in (0, 1))
    group = first + F.pmod(F.xxhash64("row"), parts).cast("int")
    anchors = written(anchors.withColumn("group", group).drop("cell"), "anchors")
    candidates = candidates.drop("anchor")

    found = _positives(anchors, candidates, cells, positives, slice_rows)
    w = Window.partitionBy("anchor").orderBy(F.desc("score"), "item", "item_row")
    found = found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= positives)
    found = written(found.select("anchor", F.col("item").alias("positive_id"), "place", F.col("score").alias("positive_score")), "positives")

    asked = found.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("asked"))
    asked = asked.select(F.col("anchor").alias("row"), F.col("asked.place").alias("places"), F.col("asked.positive_score").alias("scores"))
    taken = _negatives(anchors.join(asked, "row"), candidates, cells, negatives, low, high, slice_rows)
    w = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "item", "item_row")
    taken = taken.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= negatives)
    names = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return taken.join(found, ["anchor", "place"]).join(names, "anchor").select(
        "anchor_id", "positive_id", "rank", F.col("item").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def _served(anchors: DataFrame, cells_of: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """(group, cell): the cells that some anchor of a group may need. cells_of: anchors by cells."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, cell = np.nonzero(cells_of(batch))
            pairs = np.unique(np.stack((batch.column("group").to_numpy()[i].astype(np.int64), cell), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].astype(np.int32)), pa.array(pairs[:, 1].astype(np.int32))], names=["group", "cell"])

    return written(anchors.mapInArrow(of, "group int, cell int").distinct(), "served")


def _joined(anchors: DataFrame, candidates: DataFrame, served: DataFrame, cells: _Cells, slice_rows: int, more: str, task: Callable, schema: str) -> DataFrame:
    """task(anchors, candidates) for each group of anchors and slice of the candidates copied to it."""
    counts = anchors.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(cells.count)], "cell int, n long")
    slices = served.join(F.broadcast(counts), "cell").groupBy("group").agg(F.ceil(F.sum("n") / slice_rows).cast("int").alias("slices"))  # a row a pivot
    slices = written(slices, "slices")
    n = slices.agg(F.coalesce(F.sum("slices"), F.lit(0))).first()[0]
    columns = [x.split(" ", 1) for x in more.split(", ")] if more else []
    to = sized(written(served.join(slices, "group"), "copies"))
    slice_ = F.pmod(F.xxhash64("row"), "slices").cast("int").alias("slice")
    right = candidates.join(to, "cell").select("group", slice_, F.lit(False).alias("asks"), "row", "id", "label", "v", *(F.lit(None).cast(kind).alias(c) for c, kind in columns))
    left = anchors.join(sized(slices), "group").select("group", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(True).alias("asks"), "row", "id", "label", "v", *(c for c, _ in columns))
    both = left.unionByName(right).repartition(max(1, min(n, 4096)), "group", "slice")

    def of(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        return task(table.filter(pa.array(asks)), table.filter(pa.array(~asks)))

    return both.groupBy("group", "slice").applyInArrow(of, schema)


def _labels(a: pa.Table, b: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Labels of both as numbers, equal where labels are."""
    both = pa.chunked_array([*a.column("label").chunks, *b.column("label").chunks], a.schema.field("label").type).combine_chunks()
    codes = both.dictionary_encode().indices.to_numpy() if len(both) else np.zeros(0, np.int32)
    return codes[: a.num_rows], codes[a.num_rows :]


_FOUND = "anchor long, place int, item long, item_row long, score double"


def _answers(a: pa.Table, b: pa.Table, query: np.ndarray, owners: np.ndarray, places: np.ndarray, at: np.ndarray, score: np.ndarray) -> pa.Table:
    return pa.table({
        "anchor": a.column("row").to_numpy()[owners[query]], "place": pa.array(places[query].astype(np.int32)),
        "item": b.column("id").to_numpy()[at], "item_row": b.column("row").to_numpy()[at], "score": pa.array(score, pa.float64()),
    })


def _positives(anchors: DataFrame, candidates: DataFrame, cells: _Cells, k: int, slice_rows: int) -> DataFrame:
    """_FOUND: at least the first k other rows of each anchor's label, each with its score.

    Of each label and cell the k + 1 members nearest to the pivot are known (one may be the anchor). By way
    of the pivot they are no further from an anchor than the sum of two distances, and the k-th least of these sums
    is as far as the anchor has to look.
    """
    nearest = F.slice(F.array_sort(F.collect_list("far")), 1, k + 1)
    by = Window.partitionBy("label", "cell").orderBy("far")
    first = candidates.select("label", "cell", "far").withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= k + 1)
    known = first.groupBy("label", "cell").agg(nearest.alias("near")).groupBy("label").agg(F.collect_list("cell").alias("cells"), F.collect_list("near").alias("near"))
    pivots, longest, apart, low, high = cells.pivots, cells.longest, cells.apart, cells.low, cells.high

    def reach(batch: pa.RecordBatch) -> np.ndarray:
        far = _distances(_lifted(_matrix(batch.column("v")), longest, query=True), pivots)
        least, _ = cell_bounds(far, apart, low, high)
        out = np.zeros(far.shape, bool)
        for i, (own, near) in enumerate(zip(batch.column("cells").to_pylist(), batch.column("near").to_pylist())):
            sums = np.concatenate([far[i, c] + np.array(x) for c, x in zip(own, near)])
            limit = np.partition(sums, k)[k] * (1 + 1e-9) + 1e-6 if len(sums) > k else _FAR  # one of k + 1 may be the anchor's own
            out[i, own] = least[i, own] <= limit
        return out

    served = _served(anchors.join(sized(written(known, "known")), "label"), reach)

    def task(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y, (of_a, of_b) = _matrix(a.column("v")), _matrix(b.column("v")), _labels(a, b)
        row_a, row_b = a.column("row").to_numpy(), b.column("row").to_numpy()
        owners, none = np.arange(len(x)), np.full(len(x), _FAR)
        query, at, score = best_in_windows(
            lambda s: x @ y[s].T, b.num_rows, b.column("id").to_numpy(), row_b,
            lambda s: (of_a[:, None] == of_b[s]) & (row_a[:, None] != row_b[s]), owners, -none, none, k,
        )
        return _answers(a, b, query, owners, np.zeros(len(x), np.int64), at, score)

    return _joined(anchors, candidates, served, cells, slice_rows, "", task, _FOUND)


def _negatives(anchors: DataFrame, candidates: DataFrame, cells: _Cells, k: int, low: int, high: int, slice_rows: int) -> DataFrame:
    """_FOUND: at least the first k rows of another label in the range of scores of each anchor and place.

    A range of scores is a ring of distances. A cell is needed if its own ring meets it.
    """
    pivots, longest, apart, nearest, furthest, count = cells.pivots, cells.longest, cells.apart, cells.low, cells.high, cells.count

    def windows(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return low * scores / 100, high * scores / 100

    def reach(batch: pa.RecordBatch) -> np.ndarray:
        v = _matrix(batch.column("v"))
        far = _distances(_lifted(v, longest, query=True), pivots)
        least, most = cell_bounds(far, apart, nearest, furthest)
        square = (v * v).sum(axis=1) + longest
        out = np.zeros(far.shape, bool)
        for i, scores in enumerate(batch.column("scores").to_pylist()):
            lows, highs = windows(np.array(scores))
            for s_low, s_high in zip(lows, highs):
                if s_low <= s_high:
                    inner, outer = (np.sqrt(max(square[i] - 2 * s, 0)) for s in (s_high, s_low))
                    room = 1e-6 * (1 + outer)
                    out[i] |= (count > 0) & (least[i] <= outer + room) & (most[i] >= inner - room)
        return out

    served = _served(anchors, reach)

    def task(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y, (of_a, of_b) = _matrix(a.column("v")), _matrix(b.column("v")), _labels(a, b)
        scores = a.column("scores").to_pylist()
        owners = np.repeat(np.arange(len(x)), [len(s) for s in scores])
        places = np.array([p for ps in a.column("places").to_pylist() for p in ps], dtype=np.int64)
        p = np.array([s for own in scores for s in own], dtype=np.float64)
        lows, highs = windows(p)
        query, at, score = best_in_windows(
            lambda s: x @ y[s].T, b.num_rows, b.column("id").to_numpy(), b.column("row").to_numpy(),
            lambda s: of_a[:, None] != of_b[s], owners, lows, highs, k,
        )
        return _answers(a, b, query, owners, places, at, score)

    return _joined(anchors, candidates, served, cells, slice_rows, "places array<int>, scores array<double>", task, _FOUND)
