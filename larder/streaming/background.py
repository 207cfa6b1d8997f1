"""Motion and foreground of frames (T1, T2), and events straight from them.

Frames of a channel lie together in order of number, and a task walks them holding one background and one
frame, however long the channel is. All pixels of a frame are worked on at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from larder.functions import images as I
from larder.functions.python import sharpness
from larder.streaming import machines as M


@dataclass(frozen=True)
class View:
    """What counts as motion, and as something in front of the background."""

    delta: int = 25  # grey values that a pixel must change by
    motion: float = 0.015  # share of changed pixels that is motion
    blur: int = 5
    history: int = 500  # frames that the background remembers
    far: float = 16.0  # squared deviations beyond which a pixel is foreground
    empty_rate: float = 0.002  # rate of learning while nothing is in view
    open: int = 3
    close: int = 7
    least_area: int = 1500  # pixels of a part
    least_share: float = 0.15  # of the frame, for something to be present


class Mixture:
    """A background of up to five Gaussians a pixel, with weights, means and one variance each.

    A pixel belongs to the first of its modes, heaviest first, that it is near enough to; that one moves
    towards it and gains weight, all others lose some, and those without weight go. A pixel that no mode
    fits starts one, in place of the lightest if there are five. It is background if a mode within `far`
    squared deviations, up to the one it belongs to, is among the heaviest that hold most of the weight. Of
    equal weights the mode just used comes first.
    """

    # Fixed values of the published method.
    MODES, SHARE, NEAR, FIRST_VARIANCE, LEAST_VARIANCE, MOST_VARIANCE, PRUNE = 5, 0.9, 9.0, 15.0, 4.0, 75.0, 0.05

    def __init__(self, history: int = 500, far: float = 16.0):
        self.history, self.far, self.frames, self.weight = history, far, 0, None

    def apply(self, frame: np.ndarray, rate: float = -1.0) -> np.ndarray:
        """The mask of foreground pixels. rate: how much a frame counts; by itself 1 / (2 n) for the n-th and
        1 / history at least, as for the first frame in any case; 0 learns nothing."""
        x = frame.reshape(frame.shape[0] * frame.shape[1], *frame.shape[2:] or (1,)).astype(np.float64)
        if self.weight is None or self.mean.shape[0] != len(x) or self.mean.shape[2] != x.shape[1]:
            self.weight, self.frames = np.zeros((len(x), self.MODES)), 0
            self.mean, self.variance = np.zeros((len(x), self.MODES, x.shape[1])), np.zeros((len(x), self.MODES))
        self.frames += 1
        if rate < 0 or self.frames == 1:
            rate = 1 / min(2 * self.frames, self.history)
        pixels, w = np.arange(len(x)), self.weight
        live = w > 0
        away = x[:, None, :] - self.mean
        distance = (away * away).sum(axis=2)
        w = np.where(live, (1 - rate) * w - rate * self.PRUNE, 0.0)
        fits = live & (distance < self.NEAR * self.variance)
        own, any_ = fits.argmax(axis=1), fits.any(axis=1)
        after = np.arange(self.MODES) > np.where(any_, own, self.MODES)[:, None]
        w[(w < rate * self.PRUNE) & ~(fits & (np.arange(self.MODES) == own[:, None]))] = 0.0
        before = np.cumsum(w, axis=1) - w
        back = (live & ~after & (before < self.SHARE) & (distance < self.far * self.variance)).any(axis=1)

        p, m = pixels[any_], own[any_]
        used = own.copy()
        w[p, m] += rate
        pull = rate / w[p, m] if rate > 0 else np.zeros(len(p))
        self.mean[p, m] += pull[:, None] * away[p, m]
        spread = self.variance[p, m] + pull * (distance[p, m] - self.variance[p, m])
        self.variance[p, m] = np.clip(spread, self.LEAST_VARIANCE, self.MOST_VARIANCE)
        total = w.sum(axis=1, keepdims=True)
        w = np.divide(w, total, out=np.zeros_like(w), where=total > 0)
        if rate > 0 and not any_.all():
            p = pixels[~any_]
            m = np.minimum((w[p] > 0).sum(axis=1), self.MODES - 1)
            alone = m == 0
            w[p] *= 1 - rate
            w[p, m] = np.where(alone, 1.0, rate)
            self.mean[p, m], self.variance[p, m] = x[p], self.FIRST_VARIANCE
            used[p] = m
        order = np.lexsort((np.arange(self.MODES) != used[:, None], -w), axis=1)
        self.weight = np.take_along_axis(w, order, axis=1)
        self.variance = np.take_along_axis(self.variance, order, axis=1)
        self.mean = np.take_along_axis(self.mean, order[..., None], axis=1)
        return ~back.reshape(frame.shape[:2])


def walked(frames: DataFrame, key: str, schema: str, start: Callable[[], object], step: Callable[[object, dict], list[dict]], over: Callable[[object], list[dict]] | None = None) -> DataFrame:
    """(key, schema): rows that `step` makes of a channel's frames, in order of frame_no, from what start()
    gives; over() makes those of the channel's end. A task holds one channel's state and one batch."""
    columns = [x.split()[0] for x in schema.split(", ")]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel, state = None, None

        def rows(found: list[dict]) -> list[dict]:
            return [{key: channel} | {c: f[c] for c in columns} for f in found]

        for batch in batches:
            out = []
            for frame in batch.to_pylist():
                if state is None or frame[key] != channel:
                    out += rows(over(state)) if over and state is not None else []
                    channel, state = frame[key], start()
                out += rows(step(state, frame))
            yield pa.RecordBatch.from_pylist(out, schema=target)
        if over and state is not None:
            yield pa.RecordBatch.from_pylist(rows(over(state)), schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    whole = StructType([frames.schema[key], *StructType.fromDDL(schema).fields])
    target = to_arrow_schema(whole)
    return frames.repartition(key).sortWithinPartitions(key, "frame_no").mapInArrow(of, whole)


def pixels_of(frame: dict) -> np.ndarray:
    """(height, width, channels) of a frame's bytes; what lies beyond whole rows is left out, and a frame
    without bytes or width is empty."""
    data, width = frame["pixels"] or b"", max(0, frame["width"] or 0)
    n = max(1, frame.get("channels") or 1)
    height = len(data) // (width * n) if width else 0
    return np.frombuffer(data, np.uint8, height * width * n).reshape(height, width, n)


class Motion:
    """The share of pixels whose blurred grey value differs from that of the frame before by view.delta or
    more; 0 for a first frame, or one of another size (T1)."""

    def __init__(self, view: View):
        self.view, self.before = view, None

    def apply(self, frame: np.ndarray) -> tuple[float, int]:
        now = I.blurred(I.grey(frame), self.view.blur).astype(np.int16)
        before, self.before = self.before, now
        if before is None or before.shape != now.shape:
            return 0.0, 0
        n = int((np.abs(now - before) >= self.view.delta).sum())
        return n / max(1, now.size), n


class Foreground:
    """What stands before the background (T2): large parts of the cleaned mask."""

    def __init__(self, view: View):
        self.view, self.model = view, Mixture(view.history, view.far)

    def apply(self, frame: np.ndarray, rate: float) -> dict:
        v, shape = self.view, frame.shape[:2]
        mask, area, box = I.large_parts(I.cleaned(self.model.apply(frame, rate), v.open, v.close), v.least_area)
        n, centre, edges = int(mask.sum()), *I.box_measures(shape, box)
        share = n / max(1, mask.size)
        return {
            "fg_pixels": n, "fg_ratio": share, "present": share >= v.least_share and area >= v.least_area, "largest_area": area,
            "center_distance_ratio": centre, "edge_touch_ratio": edges,
        } | dict(zip("xywh", box or [None] * 4))


MOTION_SCHEMA = "frame_no int, motion_score double, changed_pixels int, moving boolean"
FOREGROUND_SCHEMA = "frame_no int, fg_pixels int, fg_ratio double, present boolean, largest_area int, center_distance_ratio double, edge_touch_ratio double, x int, y int, w int, h int"


def motion_scores(frames: DataFrame, key: str = "channel_id", view: View = View()) -> DataFrame:
    """(key, MOTION_SCHEMA). frames: (key, frame_no, width, pixels binary, and channels if not 1), as below."""

    def step(state: Motion, frame: dict) -> list[dict]:
        score, n = state.apply(pixels_of(frame))
        return [{"frame_no": frame["frame_no"], "motion_score": score, "changed_pixels": n, "moving": score >= view.motion}]

    return walked(frames, key, MOTION_SCHEMA, lambda: Motion(view), step)


def foreground(frames: DataFrame, key: str = "channel_id", view: View = View(), mode: str | None = None) -> DataFrame:
    """(key, FOREGROUND_SCHEMA): per frame what stands before the background, and the box of its largest part.
    mode: a column that says of a frame whether it teaches the background (`update`, as all do without the
    column), or doesn't unless nothing is there (`freeze`)."""

    def step(state: Foreground, frame: dict) -> list[dict]:
        freeze = mode is not None and frame[mode] == "freeze"
        return [{"frame_no": frame["frame_no"]} | _looked(state, pixels_of(frame), freeze)]

    return walked(frames, key, FOREGROUND_SCHEMA, lambda: Foreground(view), step)


def _looked(state: Foreground, pixels: np.ndarray, freeze: bool) -> dict:
    found = state.apply(pixels, 0.0 if freeze else -1.0)
    if freeze and not found["present"]:
        state.model.apply(pixels, state.view.empty_rate)
    return found


def video_events(frames: DataFrame, key: str = "channel_id", view: View = View(), settings: M.Settings = M.Settings()) -> DataFrame:
    """(key, events): events of the machine (T3-T5) straight from frames. The background learns while things
    move and is frozen while the scene is stable; FEATURES of sharpness that `frames` has as columns are
    taken from there, others count as 0."""

    def start() -> dict:
        return {"machine": M.new_state(), "motion": Motion(view), "front": Foreground(view), "last": 0}

    def step(state: dict, frame: dict) -> list[dict]:
        pixels = pixels_of(frame)
        score, _ = state["motion"].apply(pixels)
        seen = _looked(state["front"], pixels, state["machine"]["stable"])
        state["last"] = frame["frame_no"]
        event = M.step(state["machine"], frame | seen | {"motion_score": score, "moving": score >= view.motion}, settings)
        return [event] if event else []

    def over(state: dict) -> list[dict]:
        event = M.flush(state["machine"], state["last"], settings)
        return [event] if event else []

    return walked(frames, key, M.EVENT_SCHEMA, start, step, over)


@dataclass(frozen=True)
class TrayView:
    """What counts as a tray, and which part of a frame is looked at."""

    margin: float = 0.1  # of the frame that is left out on each side
    delta: int = 25
    blur: int = 5
    least_orange: float = 0.05
    centre: float = 0.15  # how far from the edges the tray's centre must be
    bins: int = 32


TRAY_SCHEMA = "frame_no int, present boolean, motion_pixels int, motion_score double, laplacian double, histogram array<double>, food_pixels int"


class Tray:
    """What the tray machine reads of a frame (T6, T7). A tray is there if enough of the view is orange and
    the centre of that lies well inside. Motion is what changed by more than view.delta and isn't near skin.
    Food is what is neither orange nor dark; its colours are counted by hue and saturation."""

    def __init__(self, view: TrayView):
        self.view, self.before = view, None

    def apply(self, frame: np.ndarray) -> dict:
        v = self.view
        y, x = (int(n * v.margin) for n in frame.shape[:2])
        frame = frame[y : max(y + 1, frame.shape[0] - y), x : max(x + 1, frame.shape[1] - x)]
        if not frame.size or frame.shape[2] != 3:
            return {"present": False, "motion_pixels": 0, "motion_score": 0.0, "laplacian": 0.0, "histogram": None, "food_pixels": 0}
        hsv, grey, (h, w) = I.hsv(frame), I.grey(frame), frame.shape[:2]
        orange = I.within(hsv, I.ORANGE)
        present = bool(orange.any()) and orange.mean() >= v.least_orange
        if present:
            ys, xs = np.nonzero(orange)
            present = all(n * v.centre < c < n * (1 - v.centre) for n, c in ((h, ys.mean()), (w, xs.mean())))
        now = I.blurred(grey, v.blur).astype(np.int16)
        moved = np.zeros((h, w), bool)
        if self.before is not None and self.before.shape == now.shape:
            moved = (np.abs(now - self.before) > v.delta) & ~I.dilated(I.within(hsv, I.SKIN), 7)
        self.before = now
        food = ~(orange | I.within(hsv, I.DARK))
        bins = hsv[food][:, 0] * v.bins // 180 * v.bins + hsv[food][:, 1] * v.bins // 256
        histogram = np.bincount(bins[hsv[food][:, 0] < 180], minlength=v.bins * v.bins)
        n = int(moved.sum())
        return {
            "present": bool(present), "motion_pixels": n, "motion_score": n / now.size, "laplacian": sharpness(grey)[0],
            "histogram": histogram.astype(np.float64).tolist(), "food_pixels": int(food.sum()),
        }


def tray_features(frames: DataFrame, key: str = "channel_id", view: TrayView = TrayView()) -> DataFrame:
    """(key, TRAY_SCHEMA) of colour frames (channels = 3, blue first), for the machine `tray_selector`; a
    frame without pixels has no tray and nothing that moved."""

    def step(state: Tray, frame: dict) -> list[dict]:
        return [{"frame_no": frame["frame_no"]} | state.apply(pixels_of(frame))]

    return walked(frames, key, TRAY_SCHEMA, lambda: Tray(view), step)
