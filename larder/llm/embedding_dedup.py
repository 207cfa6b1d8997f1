"""Near-duplicate vectors by quantised tile products.

Unit vectors are rounded to int8 with a scale each, and what that leaves is rounded to int8 once more.
Tiles of codes are multiplied, and each vector's rounding error bounds how far a product may be off: most
pairs are settled by that, nearly all others by the second codes with a bound of their own. Only pairs
that are still open, their cosine within some 1e-4 of the threshold, are computed in full precision, from
vectors fetched by number.

Vectors that are equal are one vector with a count. A product returns counts of links and a forest of its
links, so that a group of near copies is never written out pair by pair. Vectors are dealt into groups
that fit a task as codes, and all groups meet all groups: the work is quadratic in distinct vectors by its
nature, but a vector is copied once for each group, not for each tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import components, row_key, written

_ROWS = 256
CODES = "class long, size long, dim int, codes binary, fine binary, scale double, fine_scale double, error double, fine_error double"


def unit(raw: np.ndarray) -> np.ndarray:
    """Vectors scaled to length 1, by way of their largest component, so that no square leaves the range
    of doubles."""
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scales, what is left), in double precision: x = codes * scale + what is left."""
    most = np.abs(x).max(axis=1)
    scale = np.where(most > 0, most, 1.0) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, scale, x - codes * scale[:, None]


def _length(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """CODES of (class, size, v), where v are vectors of any lengths."""
    for whole in batches:
        for at in range(0, len(whole), 2048):
            batch = whole.slice(at, 2048)
            lists = batch.column(2)
            dims = lists.value_lengths().to_numpy()
            values = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate(([0], np.cumsum(dims)))
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                x = unit(values[starts[rows][:, None] + np.arange(dim)])
                codes, scale, rest = quantised(x)
                fine, fine_scale, last = quantised(rest)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(take), batch.column(1).take(take), pa.array(np.full(len(rows), dim, np.int32)),
                        pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([c.tobytes() for c in fine], pa.binary()),
                        *(pa.array(c) for c in (scale, fine_scale, _length(rest), _length(last))),
                    ],
                    names=[c.split()[0] for c in CODES.split(", ")],
                )


def _joined(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels (smallest member) after joining a[i] with b[i]."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        parent = np.arange(n)
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        label = parent[label]


def group_links(x: dict, y: dict, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(links of each row of x, of y, labels of the rows of x and y together, open pairs as rows of x and
    of y) of the product of two groups, or of one with itself.

    For unit a, b with rounded a', b': |a.b - a'.b'| <= |a - a'| |b| + |a'| |b - b'| <= e_a + (1 + e_a) e_b.
    Products of codes are integers below 2**24 for up to 1,040 dimensions, exact in single precision;
    beyond, doubles are used. 1e-5 and 1e-9 are more than what rounding in single and double precision adds.
    """
    n_x, n_y, dim = len(x["scale"]), len(y["scale"]), x["codes"].shape[1]
    kind = np.float32 if dim <= 1040 else np.float64
    links_x, links_y, label = np.zeros(n_x, np.int64), np.zeros(n_y, np.int64), np.arange(n_x + n_y)
    if same:
        label[n_x:] = np.arange(n_x)
    open_x, open_y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at_once = max(256, (1 << 21) // dim)

    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> None:
        nonlocal links_x, links_y, label
        i, j = (np.concatenate([np.zeros(0, np.int64), *side]) for side in (zip(*held) if held else ((), ())))
        held.clear()
        links_x += np.bincount(i, y["size"][j], n_x).astype(np.int64)
        links_y += np.bincount(j, x["size"][i], n_y).astype(np.int64)
        label = _joined(n_x + n_y, i, j if same else j + n_x, label)

    def vectors(t: dict, rows: np.ndarray) -> np.ndarray:
        return t["codes"][rows] * t["scale"][rows, None] + t["fine"][rows] * t["fine_scale"][rows, None]

    for left in range(0, n_y, 4096):
        right = min(left + 4096, n_y)
        b, b_scale = y["codes"][left:right].astype(kind).T.copy(), y["scale"][left:right].astype(kind)
        most = y["error"][left:right].max()
        for at in range(0, right if same else n_x, _ROWS):
            rows = slice(at, min(at + _ROWS, n_x))
            near = (x["codes"][rows].astype(kind) @ b) * b_scale
            error = x["error"][rows]
            least = (threshold - error - (1 + error) * most - 1e-5) / x["scale"][rows]
            i, j = np.nonzero(near >= least[:, None].astype(kind))
            about = near[i, j].astype(np.float64) * x["scale"][i + at]
            i, j = i + at, j + left
            slack = x["error"][i] + (1 + x["error"][i]) * y["error"][j] + 1e-5
            good = about + slack >= threshold
            if same:
                good &= j > i
            i, j, sure = i[good], j[good], (about - slack >= threshold)[good]
            for s in range(0, len(i), at_once):
                part = np.flatnonzero(~sure[s : s + at_once]) + s
                p, q = i[part], j[part]
                dot = np.einsum("ij,ij->i", vectors(x, p), vectors(y, q))
                bound = x["fine_error"][p] + (1 + x["fine_error"][p]) * y["fine_error"][q] + 1e-9
                sure[part] = dot - bound >= threshold
                undecided = (dot + bound >= threshold) & ~sure[part]
                open_x.append(p[undecided])
                open_y.append(q[undecided])
            held.append((i[sure], j[sure]))
            if sum(len(i) for i, _ in held) >= 1 << 20:
                flush()
    flush()
    return links_x, links_y, label, np.concatenate(open_x), np.concatenate(open_y)


def _group(table: pa.Table, dim: int) -> dict:
    codes = {c: np.frombuffer(b"".join(table.column(c).to_pylist()), np.int8).reshape(-1, dim) for c in ("codes", "fine")}
    return codes | {c: table.column(c).to_numpy() for c in ("class", "size", "scale", "fine_scale", "error", "fine_error")}


def cosine_components(
    vectors: DataFrame, threshold: float = 0.9, group_rows: int = 131_072, tasks: int = 8, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of `vectors`.

    Two vectors of the same dimension link when their cosine, in double precision, is `threshold` or
    more. n_links counts the other rows linked directly, component_id is the smallest vec_id that links
    lead to, kept tells whether that is the row's own. Vectors that are null, empty or zero, or hold null
    or non-finite components, link with nothing, nor do rows with a null vec_id. Rows that repeat count
    each; rows that share a vec_id but not a vector link each for itself. An empty table gives an empty
    table. Other columns aren't read.

    A group has `group_rows` vectors at most, and 16 MB of codes; where fewer would do, up to `tasks` are
    made of some 4,096.
    """
    vectors = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0)
    vectors = vectors.withColumn("v", F.when(good, F.transform("v", lambda x: x + F.lit(0.0))))  # -0.0 is 0.0
    key = [F.when(F.col("v").isNotNull(), x).alias(c) for c, x in zip(("key_a", "key_b"), row_key("v"))]
    classes = vectors.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("size"))
    classes = written(classes.select("*", *key).withColumn("class", F.monotonically_increasing_id()), "classes")
    # Groups of one dimension and at most some group_rows vectors.
    sizes = {r["dim"]: r["n"] for r in classes.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()}
    groups = {d: max(-(-n // max(1, min(group_rows, (1 << 24) // d))), min(tasks, -(-n // 4096))) for d, n in sizes.items()}
    spread = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])[F.col("dim")] if groups else F.lit(1)
    codes = classes.select("class", "size", "v").mapInArrow(coded, CODES).withColumn("groups", F.coalesce(spread, F.lit(1)))
    codes = written(codes.withColumn("own", F.pmod(F.xxhash64("class"), F.col("groups")).cast("int")), "codes")
    met = codes.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).withColumns(
        {"low": F.least("own", "other"), "high": F.greatest("own", "other")}
    )

    def products(key: tuple, table: pa.Table) -> pa.Table:
        dim, low, high = (k.as_py() for k in key)
        own = table.column("own").to_numpy()
        x = _group(table.filter(pa.array(own == low)), dim)
        y = x if low == high else _group(table.filter(pa.array(own == high)), dim)
        if not (len(x["class"]) and len(y["class"])):
            none = pa.array([], pa.int64())
            return pa.table({"class": none, "links": none, "to": none})
        links_x, links_y, label, p, q = group_links(x, y, threshold, same=low == high)
        ids = np.concatenate((x["class"], y["class"]))
        links = np.concatenate((links_x, links_y))
        some = (links > 0) | (label != np.arange(len(ids))) & (ids[label] != ids)
        return pa.table({
            "class": np.concatenate((ids[some], x["class"][p])),
            "links": pa.array(np.concatenate((links[some], np.full(len(p), -1)))),
            "to": np.concatenate((ids[label[some]], y["class"][q])),
        })

    n = sum(t * (t + 1) // 2 for t in groups.values())
    met = met.repartition(max(1, min(int(n), 4096)), "dim", "low", "high")
    found = met.groupBy("dim", "low", "high").applyInArrow(products, "class long, links long, to long")
    found = written(found, "products")  # links of -1: an open pair

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 1024) for whole in batches for at in range(0, len(whole), 1024)):
            v, w = (batch.column(c).to_pylist() for c in (2, 3))
            good = [float(np.dot(*unit(np.array([a, b])))) >= threshold for a, b in zip(v, w)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    side = lambda x, v: classes.select(F.col("class").alias(x), F.col("v").alias(v))
    open_ = found.where("links = -1").select(F.col("class").alias("a"), F.col("to").alias("b"))
    both = open_.join(side("a", "v"), "a").join(side("b", "w"), "b").select("a", "b", "v", "w")
    exact = written(both.mapInArrow(settle, "a long, b long"), "exact")
    ends = exact.select("a", "b").unionAll(exact.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ends = ends.join(classes.select(F.col("class").alias("b"), "size"), "b").select(F.col("a").alias("class"), F.col("size").alias("links"))
    links = found.where("links >= 0").select("class", "links").unionAll(ends).groupBy("class").agg(F.sum("links").alias("links"))
    edges = found.where("links >= 0 and class <> to").select(F.col("class").alias("a"), F.col("to").alias("b")).unionAll(exact)
    whole = components(edges).withColumnRenamed("node", "class")
    classes = classes.select("key_a", "key_b", "class", "least", "size").join(links, "class", "left").join(whole, "class", "left")
    classes = written(classes.withColumn("component", F.coalesce("component", "class")), "joined")
    least = written(classes.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    classes = classes.join(least, "component").select(
        "key_a", "key_b", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id"
    )
    return vectors.select("vec_id", *key).join(written(classes, "classes"), ["key_a", "key_b"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"),
    )
