"""A quality classifier: a generalised additive model with pairwise interactions.

Text statistics are cut into bins. Shallow trees, boosted feature after feature in turn, add up to one
lookup table per feature; then the pairs of features that explain most of what is left get tables of
their own, in the same way. A score is a sum of looked-up bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import crc_remainder
from larder.llm.textops import SPACED, buffers, rolling, slices, word_hashes, word_spans

FEATURES = [
    "log_bytes", "log_words", "word_length", "word_length_spread", "upper", "digits", "stops", "marks",
    "bars", "calls", "lines", "distinct_words", "distinct_pairs", "longest_word",
]

# Kinds of bytes, and one more for all others.
_KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "stop": b".,;:?'\"()-", "bar": b"|", "call": b"!", "line": b"\n", "space": b" \t\r\x0b\x0c"}
_KIND = np.full(256, len(_KINDS), dtype=np.int64)
for _i, _bytes in enumerate(_KINDS.values()):
    _KIND[list(_bytes)] = _i
_KIND[128:] = 1


def _distinct(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    bounds = np.searchsorted(text, np.arange(n + 1))
    return np.array([len(np.unique(values[bounds[i] : bounds[i + 1]])) for i in range(n)], dtype=np.float64)


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; all 0 for an empty one."""
    raw, offsets = buffers(column)
    n = len(column)
    text = np.repeat(np.arange(n), np.diff(offsets))
    kinds = len(_KINDS) + 1
    c = np.bincount(text * kinds + _KIND[raw], minlength=n * kinds).reshape(n, kinds).astype(np.float64)
    upper, lower, digit, stop, bar, call, line, _, other = c.T
    starts, ends = word_spans(raw, offsets, SPACED)
    lengths = (ends - starts + 1).astype(np.float64)
    of = text[starts] if len(starts) else np.zeros(0, np.int64)
    words = np.bincount(of, minlength=n).astype(np.float64)
    some = np.maximum(words, 1)
    mean = np.bincount(of, lengths, n) / some
    spread = np.sqrt(np.maximum(np.bincount(of, lengths**2, n) / some - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, of, lengths)
    hashes, counts = word_hashes(column, SPACED)
    pairs, pair_text, _ = rolling(hashes, counts, 2)
    letters = np.maximum(upper + lower, 1)
    return np.column_stack([
        np.log1p(np.diff(offsets)), np.log1p(words), mean, spread, upper / letters, digit / some, stop / some, other / some,
        bar / some, call / some, line / some, _distinct(hashes, np.repeat(np.arange(n), counts), n) / some,
        _distinct(pairs, pair_text, n) / np.maximum(words - 1, 1), np.log1p(longest),
    ])


@dataclass
class Model:
    """edges: bin borders of each feature; tables: one value a bin; coarse, pairs: the same for pairs."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            z += table[np.searchsorted(edges, x[:, j], side="right")]
        for i, j, table in self.pairs:
            a, b = (np.searchsorted(self.coarse[f], x[:, f], side="right") for f in (i, j))
            z += table[a, b]
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g: np.ndarray, h: np.ndarray, smooth: float) -> np.ndarray:
    return g * g / (h + smooth)


def _tree(g: np.ndarray, h: np.ndarray, smooth: float, depth: int = 2) -> np.ndarray:
    """A tree on the sums of gradients and curvatures of ordered bins: the step of each bin."""
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gains = _gain(left_g, left_h, smooth) + _gain(g.sum() - left_g, h.sum() - left_h, smooth)
        cut = int(np.argmax(gains)) + 1
        if gains[cut - 1] > _gain(g.sum(), h.sum(), smooth) + 1e-9:
            return np.concatenate((_tree(g[:cut], h[:cut], smooth, depth - 1), _tree(g[cut:], h[cut:], smooth, depth - 1)))
    return np.full(len(g), g.sum() / (h.sum() + smooth))


def _pair_tree(g: np.ndarray, h: np.ndarray, smooth: float) -> tuple[np.ndarray, float]:
    """The best cut of one feature, then of the other on either side: (steps, gain)."""
    best, at = None, -np.inf
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for cut in range(1, len(a)):
            rows = [_tree(a[s].sum(axis=0), b[s].sum(axis=0), smooth, 1) for s in (slice(0, cut), slice(cut, None))]
            gain = sum(float((r * a[s].sum(axis=0)).sum()) for r, s in zip(rows, (slice(0, cut), slice(cut, None))))
            if gain > at:
                table = np.vstack([np.repeat(rows[0][None], cut, 0), np.repeat(rows[1][None], len(a) - cut, 0)])
                best, at = table.T if turned else table, gain
    return (best if best is not None else np.zeros(g.shape)), at


def train(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.2, bins: int = 32, pair_bins: int = 6, n_pairs: int = 4, pair_rounds: int = 15, smooth: float = 5.0) -> Model:
    """Cyclic gradient boosting of the logistic loss. Rows may be any order; nothing is random."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(float(np.log(share / (1 - share))), [np.zeros(0)] * x.shape[1], [np.zeros(1)] * x.shape[1], [np.zeros(0)] * x.shape[1], [])
    edges = [_edges(x[:, j], bins) for j in range(x.shape[1])]
    at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    intercept = float(np.log(y.mean() / (1 - y.mean())))
    z = np.full(len(y), intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, table in enumerate(tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(at[j], g, len(table)), np.bincount(at[j], h, len(table)), smooth)
            table += step
            z += step[at[j]]
    coarse = [_edges(x[:, j], pair_bins) for j in range(x.shape[1])]
    by = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(coarse)]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        cell = by[i] * shape[1] + by[j]
        return tuple(np.bincount(cell, s, shape[0] * shape[1]).reshape(shape) for s in slopes())

    ranked = sorted(((_pair_tree(*sums(i, j), smooth)[1], i, j) for i in range(len(by)) for j in range(i)), reverse=True)
    pairs = [(i, j, np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for _, i, j in ranked[:n_pairs]]
    for _ in range(pair_rounds):
        for i, j, table in pairs:
            step = rate * _pair_tree(*sums(i, j), smooth)[0]
            table += step
            z += step[by[i], by[j]]
    return Model(intercept, edges, tables, coarse, pairs)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, **options) -> Model:
    """A model from at most `max_rows` labelled documents, those whose ids hash lowest.

    docs: (doc_id, text), labels: (doc_id, label 0 or 1). Labels without a document take no place in the
    sample. Features of the sample, `max_rows` rows of numbers however often an id stands in `docs`, go to
    the driver, which trains on them.
    """
    labels = labels.where("label is not null and doc_id is not null").select("doc_id", F.col("label").cast("double").alias("label"))
    held = docs.select("doc_id").join(labels, "doc_id").distinct()  # ids alone: no text is shuffled
    sample = held.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = features(part.column(1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64())), part.column(2)],
                    names=["doc_id", "x", "label"],
                )

    rows = (
        docs.join(F.broadcast(sample), "doc_id")  # `max_rows` rows at most
        .select("doc_id", "text", "label")
        .mapInArrow(of, "doc_id long, x array<double>, label double")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label", "x")
        .limit(max_rows)
        .toPandas()
    )
    x = np.array(rows["x"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return train(x, rows["label"].to_numpy(np.float64), **options)


def predict(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """`docs` with a column `out` double after its own, which must have no such name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers
    at = docs.columns.index(text)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                scores = shared.value.score(features(part.column(at)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], names=[*part.schema.names, out])

    return docs.mapInArrow(of, T.StructType(list(docs.schema.fields)).add(out, "double"))


def score_documents(
    docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, doc_id: str = "doc_id", text: str = "text", label: str = "quality"
) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of `docs`.

    Learns from labels of rows whose crc32(doc_id as text) mod 3 isn't 1; those with 1 are held_out.
    Only text is an input of a score. Null and empty texts are scored too. With no labels, or one kind
    alone, all scores are the share of label 1 (of rows and one more of either kind). Null labels don't
    count; a document with two labels counts twice. Other columns aren't read.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    labels = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).alias("label")).where(crc_remainder("doc_id") != 1)
    found = predict(docs, fit(docs, labels, max_rows))
    return found.select("doc_id", (crc_remainder("doc_id") == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
