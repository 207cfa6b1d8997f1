"""Product codes of vectors: each part of a vector becomes the index of the nearest entry of that part's
codebook.

Components are integers, so every distance has one right value. The nearest entry is found in two steps:
a product in single precision gives all distances of a block with an interval each, rigorous for any order
of summation, and the entries whose interval reaches that of the best are evaluated again in 64-bit
integers, equal ones going by index. Vectors are never shuffled: a round of fitting is a scan whose tasks
return sums and counts for each entry, a table that doesn't grow with the vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import fresh, sized, written

_BLOCK = 4096
_UNIT = 2.0**-24  # half the distance between 1 and the next number in single precision


@dataclass
class Codebooks:
    """`entries`: integers by part, entry and place in the part; `dim` is 0 if there were no vectors."""

    entries: np.ndarray

    @property
    def dim(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2] if self.entries.shape[1] else 0

    def sha256(self) -> str:
        """Over the decimal components by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def integer_vector(embedding: str | Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as a long; null where the vector is null or holds a null, a
    non-finite component, or one beyond a long."""
    v = (F.col(embedding) if isinstance(embedding, str) else embedding).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x * scale) >= 2.0**62)
    return F.when(v.isNotNull() & ~F.exists(v, bad), F.transform(v, lambda x: F.floor(x * scale)))


def nearest(part: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) of each row of `part`; of equals the lowest index.

    |p|^2 is left out of the products: what remains is [p, 1] . [-2c, |c|^2], w + 1 terms for parts of
    w components. With inputs rounded to single precision, a product lies within g * (2 |p| |c| + |c|^2) of
    the right value, g = k u / (1 - k u) for k = w + 3, whichever way terms are added up; k is taken larger
    to cover the rounding of the bound itself and that of |c|^2.
    """
    w = part.shape[1]
    most = int(np.abs(part).max(initial=0)), int(np.abs(entries).max(initial=0))
    if w * (most[0] + most[1]) ** 2 >= 2**63:
        raise OverflowError("squared distances of these components don't fit in 64 bits")
    c = entries.astype(np.float64)
    norms = (c * c).sum(axis=1)
    right = np.vstack((-2 * c.T, norms)).astype(np.float32)
    left = np.hstack((part, np.ones((len(part), 1)))).astype(np.float32)
    p = part.astype(np.float64)
    slack = 2 * (w + 8) * _UNIT * (2 * np.sqrt((p * p).sum(axis=1) * norms.max()) + norms.max())
    index = np.empty(len(part), np.int64)
    for at in range(0, len(part), _BLOCK):
        rows = slice(at, at + _BLOCK)
        near = left[rows] @ right
        index[rows] = near.argmin(axis=1)
        limit = near.min(axis=1).astype(np.float64) + 2 * slack[rows]
        limit = np.nextafter(limit.astype(np.float32), np.float32(np.inf))
        over = near <= limit[:, None]
        open_ = np.flatnonzero(over.sum(axis=1) > 1)
        if len(open_):
            i, j = np.nonzero(over[open_])
            d = part[open_[i] + at] - entries[j]
            exact = (d * d).sum(axis=1)
            order = np.lexsort((j, exact, i))
            first = order[np.concatenate(([True], i[order][1:] != i[order][:-1]))]
            index[open_ + at] = j[first]
    d = part - entries[index]
    return index, (d * d).sum(axis=1)


def _parts(batch: pa.Array, n: int) -> np.ndarray:
    """(rows, parts, width) of a list array without nulls, all lists being of one length."""
    return batch.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), n, -1)


def _with_integers(vectors: DataFrame, vec_id: str, embedding: str, scale: int, *others: str) -> DataFrame:
    kept = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), integer_vector(embedding, scale).alias("v"), *others)
    return kept.where("v is not null")


def fit(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> Codebooks:
    """Codebooks of `vectors`, which are read once for the start and once a round.

    Entries start as the parts of the vectors with the `entries` smallest ids, ascending (rows of one id by
    their components; null ids don't start one). A round assigns every part to its nearest entry and
    replaces each entry by floor(sum / count) of its parts; entries without parts stay. Vectors that are null, or hold null
    or non-finite components, are left out, and so are those whose length isn't that of the smallest id
    whose length is a multiple of `parts`. Fewer vectors than `entries` give fewer entries, none give none.
    """
    if not 0 < entries <= 256:
        raise ValueError("codes are bytes: 1 to 256 entries")
    whole = _with_integers(vectors, vec_id, embedding, scale)
    fits = whole.where((F.size("v") > 0) & (F.size("v") % parts == 0) & F.col("vec_id").isNotNull())
    one = fits.orderBy("vec_id", "v").select(F.size("v").alias("n")).first()
    if one is None:
        return Codebooks(np.zeros((parts, 0, 0), np.int64))
    first = fits.where(F.size("v") == one["n"]).orderBy("vec_id", "v").limit(entries).collect()
    books = np.array([r["v"] for r in first], dtype=np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    width = books.shape[2]
    for _ in range(rounds):
        now = books

        def sums(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            total = np.zeros((*now.shape[:2], width + 1), np.int64)
            for batch in batches:
                x = _parts(batch.column(0), parts)
                for p in range(parts):
                    index, _ = nearest(x[:, p], now[p])
                    total[p, :, width] += np.bincount(index, minlength=now.shape[1])
                    for i in range(width):
                        np.add.at(total[p, :, i], index, x[:, p, i])
            p, e, i = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (p, e, i, total[p, e, i])], names=["p", "e", "i", "n"])

        got = whole.where(F.size("v") == one["n"]).select("v").mapInArrow(sums, "p long, e long, i long, n long")
        found = got.groupBy("p", "e", "i").agg(F.sum(F.col("n").cast("decimal(28,0)")).alias("n")).collect()
        total = {(r["p"], r["e"], r["i"]): int(r["n"]) for r in found}
        books = now.copy()
        for (p, e, i), n in total.items():
            if i == width:
                books[p, e] = [total.get((p, e, k), 0) // n for k in range(width)]
    return Codebooks(books)


def encode(vectors: DataFrame, books: Codebooks, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding", others: tuple[str, ...] = ()) -> DataFrame:
    """(vec_id, code binary, error long, `others`): a byte for each part, and the squared distance to what
    the code stands for. A map over the vectors; those of another length have null codes and errors."""
    n, (code, error) = books.entries.shape[0], fresh((*others, "vec_id", "v"), "code", "error")
    whole = _with_integers(vectors, vec_id, embedding, scale, *others)
    schema = whole.drop("v").schema.add(code, "binary").add(error, "long")
    names = [c for c in whole.columns if c != "v"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            good = np.flatnonzero(lists.value_lengths().to_numpy(zero_copy_only=False) == books.dim) if books.dim else np.zeros(0, np.int64)
            codes, errors = np.zeros((len(good), n), np.uint8), np.zeros(len(good), np.int64)
            if len(good):
                x = _parts(lists.take(pa.array(good)), n)
                for p in range(n):
                    codes[:, p], d = nearest(x[:, p], books.entries[p])
                    errors += d
            at = np.full(len(batch), -1)
            at[good] = np.arange(len(good))
            take = pa.array(at, mask=at < 0)
            columns = [pa.array([c.tobytes() for c in codes], pa.binary()).take(take), pa.array(errors).take(take)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns], names=[*names, code, error])

    return whole.mapInArrow(of, schema)


def decode(codes: DataFrame, books: Codebooks, scale: int = 256, code: str = "code") -> DataFrame:
    """`codes` with vector: what each code stands for, array<double>."""
    flat = books.entries.astype(np.float64) / scale

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if b is None else flat[np.arange(len(flat)), np.frombuffer(b, np.uint8)].ravel() for b in batch.column(code).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.float64()))], names=[*batch.schema.names, "vector"])

    return codes.drop("vector").mapInArrow(of, codes.drop("vector").schema.add("vector", T.ArrayType(T.DoubleType())))


def code_digest(vectors: DataFrame, label: str = "label", **options) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), one row per vector that fit() looks at or would
    but for its length, in which case code and error are null: codes in hex, the sum of the errors of all
    vectors with the row's label (null ones together), and the digest of the codebooks they were made with.

    Rows that repeat count each. An empty table gives an empty table.
    """
    books = fit(vectors, **options)
    columns = {k: v for k, v in options.items() if k in ("scale", "vec_id", "embedding")}
    rows = vectors.select(F.col(columns.get("vec_id", "vec_id")).alias("vec_id"), F.col(columns.get("embedding", "embedding")).alias("embedding"), F.col(label).alias("label"))
    coded = written(encode(rows, books, columns.get("scale", 256), others=("label",)), "codes")
    by_label = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    by_label = sized(by_label.withColumnRenamed("label", "_label"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")), "left").select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256")
    )
