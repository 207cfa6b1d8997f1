"""Language identification by mixture inference.

Languages are distributions over hashed letter trigrams, counted over every labelled text. A document
is a mixture of them: expectation-maximisation estimates its proportions, and a penalised likelihood
decides how many languages it needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import crc_remainder, handed_back

_BITS = 16
BUCKETS = 1 << _BITS
UNKNOWN = "und"
_BLOCK = 1 << 20
_letters: list[np.ndarray] = []


def _is_letter(code: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(1 << 16)]))
    low = code < 1 << 16
    out = _letters[0][np.where(low, code, 0)]
    if not low.all():
        values, at = np.unique(code[~low], return_inverse=True)
        out[~low] = np.array([chr(v).isalpha() for v in values])[at]
    return out


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(trigram bucket of each place of the texts in turn, first place of each text and the end). Words
    are runs of letters in lower case; a trigram may hold a word's beginning or end."""
    texts = [t.lower() for t in texts]
    sizes = np.array([len(t) + 2 for t in texts])
    code = np.frombuffer("".join(f"\0{t}\0" for t in texts).encode("utf-32-le", "replace"), np.uint32)
    letter = _is_letter(code)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:-1] |= letter[1:] & ~letter[:-1]
    text = np.repeat(np.arange(len(texts)), sizes)[keep]
    c = np.where(letter, code, 0)[keep].astype(np.uint64)
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    h = c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:] * np.uint64(0x165667B19E3779F9)
    h = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - _BITS)
    # a trigram needs its middle letter; its sides may be letters or edges of the word
    good = (c[1:-1] != 0) & (text[:-2] == text[2:])
    return h[good].astype(np.int64), np.searchsorted(text[1:-1][good], np.arange(len(texts) + 1))


def _blocks(texts: list[str | None]) -> Iterator[list[str]]:
    block, size = [], 0
    for t in texts:
        block.append(t or "")
        size += len(block[-1])
        if size >= _BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def language_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of `docs` (text, lang); at most BUCKETS rows a language."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, at = batch.column(1).to_pylist(), 0
            for block in _blocks(batch.column(0).to_pylist()):
                h, bounds = _grams(block)
                own = langs[at : at + len(block)]
                for lang in set(own):
                    grams = [h[bounds[i] : bounds[i + 1]] for i, x in enumerate(own) if x == lang]
                    total = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    total += np.bincount(np.concatenate(grams), minlength=BUCKETS)
                at += len(block)
        for lang, total in counts.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(total[some])], names=["lang", "gram", "n"]
            )

    return docs.select("text", "lang").mapInArrow(handed_back(of), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model(NamedTuple):
    """Languages, probabilities of shape BUCKETS x languages, and how many buckets some language has."""

    names: list[str]
    p: np.ndarray
    used: int


def fit(docs: DataFrame, smoothing: float = 0.5) -> Model:
    """A model from rows of `docs` that have both text and lang. The driver gets BUCKETS counts a
    language, whatever the number of rows. `smoothing` counts for each bucket in use are spread over all."""
    rows = language_counts(docs.where("text is not null and lang is not null")).toPandas()
    names = sorted(rows["lang"].unique())
    used = int(rows["gram"].nunique())
    counts = np.full((BUCKETS, len(names)), smoothing * max(used, 1) / BUCKETS)
    counts[rows["gram"].to_numpy(np.int64), rows["lang"].map({x: i for i, x in enumerate(names)}).to_numpy(np.int64)] += rows["n"]
    return Model(names, counts / counts.sum(axis=0), used)


def proportions(p: np.ndarray, n: np.ndarray, rounds: int = 60, settled: float = 1e-4) -> tuple[np.ndarray, float]:
    """Expectation-maximisation: (share of each language, log-likelihood). p: grams x languages, n: the
    count of each gram."""
    w = np.full(p.shape[1], 1 / p.shape[1])
    total = n.sum()
    for _ in range(rounds if len(w) > 1 else 0):
        new = w * (n / (p @ w) @ p) / total
        done = np.abs(new - w).max() < settled
        w = new
        if done:
            break
    return w, float(n @ np.log(p @ w))


def infer(p: np.ndarray, n: np.ndarray, penalty: float, logs: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """(share of each language, log-likelihood) under the language set with the best likelihood less
    `penalty` * log(grams) for each language beyond the first.

    From the best single language on, sets change by the step that helps most, adding, removing or
    exchanging a language, until none helps; no number of languages is too many. The likelihood is
    concave in the shares, so its slope bounds what a language can add: most are never tried. logs: the
    logarithms of p, if they are at hand.
    """
    total = n.sum()
    cost = penalty * np.log(total + 1)
    single = n @ (np.log(p) if logs is None else logs)
    best = [int(np.argmax(single))]
    w, likelihood = np.ones(1), float(single[best[0]])
    if p.shape[1] > 1:
        tried = {tuple(best): (w, likelihood)}
        while True:
            slack = total * (n / (p[:, best] @ w) @ p / total - 1)  # the most that each language can add
            others = [j for j in np.flatnonzero(slack > 0) if j not in best]
            sets = [sorted([*best, j]) for j in others if slack[j] > cost]
            if len(best) > 1:
                sets += [[x for x in best if x != i] for i in best]
                sets += [sorted([*(x for x in best if x != i), j]) for i in best for j in others]
            at, chosen = likelihood - cost * (len(best) - 1) + 1e-9, None
            for s in sets:
                found = tried.get(tuple(s))
                if found is None:
                    found = tried[tuple(s)] = proportions(p[:, s], n)
                if found[1] - cost * (len(s) - 1) > at:
                    at, chosen = found[1] - cost * (len(s) - 1), s
            if chosen is None:
                break
            best, (w, likelihood) = chosen, tried[tuple(chosen)]
    shares = np.zeros(p.shape[1])
    shares[best] = w
    return shares, likelihood


#: What `predict` adds, by name.
PREDICTED = {
    "lang_pred": T.StringType(),
    "score": T.DoubleType(),
    "languages": T.IntegerType(),
    "gain": T.DoubleType(),
    "shares": T.ArrayType(T.StructType().add("lang", T.StringType()).add("share", T.DoubleType())),
}


def predict(
    docs: DataFrame, model: Model, penalty: float = 2.0, text: str = "text", out: dict[str, str] | None = None
) -> DataFrame:
    """`docs` with the columns of PREDICTED, or those that `out` names, under the names that it gives.
    Names must differ from those of `docs`.

    lang_pred is the language of the largest share, score that share, languages the size of the chosen
    set, shares its languages with their shares, the largest first. gain is the mean log-likelihood of a
    trigram above that of noise (all trigrams that any language has alike), 0 or less for text that is
    like none of the languages. A null text, or one without a letter, is `und` with score 0 and no shares; so is every text
    if nothing could be learned.
    """
    names, p, used = model
    out = {x: x for x in PREDICTED} if out is None else out
    shared = docs.sparkSession.sparkContext.broadcast((p, np.log(p)))  # BUCKETS doubles a language, twice
    at = docs.columns.index(text)
    schema = T.StructType(list(docs.schema.fields))
    for x, name in out.items():
        schema = schema.add(name, PREDICTED[x])
    kinds = {
        "lang_pred": pa.string(), "score": pa.float64(), "languages": pa.int32(), "gain": pa.float64(),
        "shares": pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])),
    }

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, logs = shared.value
        for batch in batches:
            rows: dict[str, list] = {x: [] for x in PREDICTED}
            for block in _blocks(batch.column(at).to_pylist()):
                h, bounds = _grams(block)
                for i in range(len(block)):
                    some, n = np.unique(h[bounds[i] : bounds[i + 1]], return_counts=True)
                    if not len(some) or not names:
                        row = (UNKNOWN, 0.0, 0, 0.0, [])
                    else:
                        n = n.astype(np.float64)
                        w, likelihood = infer(p[some], n, penalty, logs[some])
                        order = [j for j in np.argsort(-w, kind="stable") if w[j] > 0]
                        shares = [{"lang": names[j], "share": min(1.0, float(w[j]))} for j in order]
                        row = (shares[0]["lang"], shares[0]["share"], len(shares), likelihood / n.sum() + np.log(used), shares)
                    for x, value in zip(PREDICTED, row):
                        rows[x].append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(rows[x], kinds[x]) for x in out)], names=schema.names)

    return docs.mapInArrow(handed_back(of), schema)


def identify(docs: DataFrame, penalty: float = 2.0, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, languages, gain, shares), one row per row of `docs`.

    Learns from rows whose crc32(doc_id as text) mod 3 isn't 1 and that have both text and lang; those
    with 1 are held_out. lang, source and doc_id are no inputs of a prediction. Repeated rows are
    predicted alike; a null id counts as empty text for the fold. Other columns aren't read.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    model = fit(docs.where(crc_remainder("doc_id") != 1))
    found = predict(docs.select("doc_id", "text"), model, penalty)
    return found.select("doc_id", (crc_remainder("doc_id") == 1).alias("held_out"), *PREDICTED)
