"""The few functions that have no built-in form: difflib's ratio, the C library's logarithm and sharpness of images."""

from __future__ import annotations

import io
import math
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types as objects: a DDL string would need a session while this module is imported.
SHARPNESS = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in ("laplacian", "tenengrad", "local_clarity", "high_freq_ratio", "exposure_outlier_ratio")]
)


@F.pandas_udf(T.DoubleType())
def text_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's similarity of two texts, in their order; 0 with a null (F16)."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else 0.0 for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def log(x: pd.Series) -> pd.Series:
    """The C library's logarithm of positive numbers. Java's differs in the last bit of one in a hundred, which
    decides the order of scores that are otherwise equal."""
    return pd.Series([math.log(v) for v in x], dtype="float64")


def sharpness(gray: np.ndarray) -> tuple[float, float, float, float, float]:
    """(variance of the Laplacian, mean squared gradient, the least of both's nine tiles' Laplacian
    variances, share of spectrum energy outside .12 of the shorter side, share of nearly black or white
    pixels) of a grey image (F33)."""
    g = gray.astype(np.float64)
    p = np.pad(g, 1, mode="reflect") if min(g.shape) > 1 else np.pad(g, 1, mode="edge")
    laplace = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g
    rows = p[:-2] + 2 * p[1:-1] + p[2:]
    columns = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    gx, gy = rows[:, 2:] - rows[:, :-2], columns[2:] - columns[:-2]
    tiles = [t for band in np.array_split(laplace, 3, 0) for t in np.array_split(band, 3, 1) if t.size]
    spectrum = np.abs(np.fft.fftshift(np.fft.fft2(g))) ** 2
    y, x = np.indices(g.shape)
    far = (y - g.shape[0] // 2) ** 2 + (x - g.shape[1] // 2) ** 2 > (0.12 * min(g.shape)) ** 2
    total = spectrum.sum()
    return (
        float(laplace.var()),
        float((gx**2 + gy**2).mean()),
        float(min(t.var() for t in tiles)),
        float(spectrum[far].sum() / total) if total > 0 else 0.0,
        float(((gray <= 5) | (gray >= 250)).mean()),
    )


@F.pandas_udf(SHARPNESS)
def frame_sharpness(frame: pd.Series) -> pd.DataFrame:
    """`sharpness` of images stored as .npy bytes of a grey array; nulls for what can't be read."""
    rows = []
    for data in frame:
        try:
            rows.append(sharpness(np.load(io.BytesIO(data), allow_pickle=False)))
        except (TypeError, ValueError, OSError, EOFError):
            rows.append((None,) * 5)
    return pd.DataFrame(rows, columns=SHARPNESS.fieldNames())


def even_sample(n: int, most: int) -> list[int]:
    """Indices of at most `most` of n frames, evenly spread, first and last included."""
    if n <= most:
        return list(range(n))
    return [round(x) for x in np.linspace(0, n - 1, most)]
