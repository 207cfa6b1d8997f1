"""Frames as arrays (T1, T2, T7): grey values, blur, masks and their components. Numpy inside tasks."""

from __future__ import annotations

import numpy as np

# Shares of blue, green and red in a grey value, in 1 / 32768; weights of a blur by its width.
GREY = (3735, 19235, 9798)
BLURS = {1: [1.0], 3: [0.25, 0.5, 0.25], 5: [0.0625, 0.25, 0.375, 0.25, 0.0625], 7: [0.03125, 0.109375, 0.21875, 0.28125, 0.21875, 0.109375, 0.03125]}
# Hue (0-180), saturation and value from and to of a tray's orange, of skin, and of what is dark.
ORANGE = (5, 80, 80), (25, 255, 255)
SKIN = (0, 30, 60), (25, 180, 255)
DARK = (0, 0, 0), (180, 255, 50)


def odd(n: int) -> int:
    return n if n % 2 else n + 1


def grey(frame: np.ndarray) -> np.ndarray:
    """Of (height, width, 3), blue first; a frame of one channel is grey already."""
    if frame.ndim == 2 or frame.shape[2] == 1:
        return frame.reshape(frame.shape[:2])
    return ((frame.astype(np.int64) @ np.array(GREY) + (1 << 14)) >> 15).astype(np.uint8)


def blurred(image: np.ndarray, width: int = 5) -> np.ndarray:
    """Gaussian blur of whole numbers, rounded half up; beyond an edge the image is mirrored about it."""
    width = odd(width)
    if not image.size:
        return image.astype(np.uint8)
    if width in BLURS:
        w = np.array(BLURS[width])
    else:
        sigma = 0.3 * ((width - 1) * 0.5 - 1) + 0.8
        w = np.exp(-((np.arange(width) - width // 2) ** 2) / (2 * sigma * sigma))
        w /= w.sum()
    out, r = image.astype(np.float64), width // 2
    for axis in (0, 1):
        n = out.shape[axis]
        at = np.abs(np.arange(-r, n + r)) % max(1, 2 * n - 2)
        at = np.minimum(at, np.maximum(2 * n - 2 - at, 0)) if n > 1 else np.zeros(n + 2 * r, np.int64)
        wide = out.take(at, axis=axis)
        out = sum(w[i] * wide.take(np.arange(i, i + n), axis=axis) for i in range(width))
    return np.floor(out + 0.5).astype(np.uint8)


def hsv(frame: np.ndarray) -> np.ndarray:
    """(hue 0-180, saturation, value) of (height, width, 3), blue first."""
    b, g, r = (frame[..., i].astype(np.int64) for i in range(3))
    v = np.maximum(np.maximum(b, g), r)
    spread = v - np.minimum(np.minimum(b, g), r)
    share = lambda top, low: np.rint(np.divide(top * 4096.0, low, out=np.zeros(low.shape), where=low > 0)).astype(np.int64)
    s = (spread * share(255, v) + 2048) >> 12
    h = np.where(v == r, g - b, np.where(v == g, b - r + 2 * spread, r - g + 4 * spread))
    h = (h * share(30, spread) + 2048) >> 12
    return np.stack((np.where(h < 0, h + 180, h), s, v), axis=-1)


def within(hsv_: np.ndarray, bounds: tuple[tuple, tuple]) -> np.ndarray:
    return ((hsv_ >= bounds[0]) & (hsv_ <= bounds[1])).all(axis=-1)


def _slid(mask: np.ndarray, width: int, outside: bool, hit: bool) -> np.ndarray:
    """Whether a square of `width` around each pixel has any pixel of value `hit`; `outside` is what lies
    beyond the edges."""
    r = width // 2
    n = np.pad(np.pad(mask, r, constant_values=outside) == hit, ((1, 0), (1, 0))).astype(np.int64).cumsum(0).cumsum(1)
    return n[width:, width:] - n[:-width, width:] - n[width:, :-width] + n[:-width, :-width] > 0


def dilated(mask: np.ndarray, width: int) -> np.ndarray:
    return _slid(mask, odd(width), False, True)


def eroded(mask: np.ndarray, width: int) -> np.ndarray:
    return ~_slid(mask, odd(width), True, False)


def cleaned(mask: np.ndarray, open_: int = 3, close: int = 7) -> np.ndarray:
    """Opened, so that specks go, then closed, so that gaps do."""
    mask = dilated(eroded(mask, open_), open_)
    return eroded(dilated(mask, close), close)


def components(mask: np.ndarray) -> np.ndarray:
    """Numbers of the connected parts, from 1 in order of their first pixels, 0 outside; pixels touch at
    corners too. Runs of each row are united with those of the row above that they touch."""
    h, w = mask.shape
    padded = np.zeros((h, w + 2), np.int8)
    padded[:, 1:-1] = mask
    step = np.diff(padded, axis=1)
    row, start = np.nonzero(step == 1)
    _, end = np.nonzero(step == -1)  # the pixel after the last
    n = len(row)
    first = np.searchsorted(row, np.arange(h + 1))
    a, b = [], []
    for y in range(1, h):
        up, own = slice(first[y - 1], first[y]), slice(first[y], first[y + 1])
        low = np.searchsorted(end[up], start[own])  # ends at or right of the start touch by a corner at least
        high = np.searchsorted(start[up], end[own], side="right")
        many = np.maximum(high - low, 0)
        a.append(np.repeat(np.arange(first[y], first[y + 1]), many))
        b.append(np.repeat(low + first[y - 1], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
    a, b = (np.concatenate((np.zeros(0, np.int64), *x)) for x in (a, b))
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        parent = np.arange(n)
        np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]
    number = np.unique(label, return_inverse=True)[1] + 1 if n else label
    out = np.zeros(h * w + 1, np.int64)
    np.add.at(out, row * w + start, number)
    np.add.at(out, row * w + end, -number)
    return np.cumsum(out)[:-1].reshape(h, w) if n else out[:-1].reshape(h, w)


def large_parts(mask: np.ndarray, least: int) -> tuple[np.ndarray, int, tuple[int, int, int, int] | None]:
    """(mask of the parts of `least` pixels or more, pixels of the largest, its box x, y, width, height).
    Of equal parts the first counts as the largest."""
    label = components(mask)
    areas = np.bincount(label.ravel(), minlength=1)
    areas[0] = 0
    big = areas >= max(1, least)
    if not big.any():
        return np.zeros_like(mask), 0, None
    best = int(areas.argmax())
    ys, xs = np.nonzero(label == best)
    box = int(xs.min()), int(ys.min()), int(np.ptp(xs)) + 1, int(np.ptp(ys)) + 1
    return big[label], int(areas[best]), box


def box_measures(shape: tuple[int, int], box: tuple[int, int, int, int] | None) -> tuple[float, float]:
    """(distance of the box's centre from the image's, in halves of the image; share of the four edges that
    the box touches, within 2 % of the size); 1 and 1 without a box."""
    if box is None:
        return 1.0, 1.0
    (h, w), (x, y, bw, bh) = shape, box
    across, along = (x + bw / 2 - w / 2) / max(1.0, w / 2), (y + bh / 2 - h / 2) / max(1.0, h / 2)
    mx, my = max(1, round(w * 0.02)), max(1, round(h * 0.02))
    return float(np.hypot(across, along)), ((x <= mx) + (y <= my) + (x + bw >= w - mx) + (y + bh >= h - my)) / 4
