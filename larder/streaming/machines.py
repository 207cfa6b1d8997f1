"""Event detection over frame features (T1-T8): two machines, one key at a time, one frame after another.

State is a dict of numbers and short lists, so that a stream can keep it as JSON. Frames themselves are
never kept, only features of candidates.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import median

FEATURES = ["laplacian", "tenengrad", "local_clarity", "high_freq_ratio", "exposure_outlier_ratio", "temporal_diff", "completeness", "edge_touch_ratio", "center_distance_ratio"]
EVENT_COLUMNS = ["start_frame_no", "end_frame_no", "best_frame_no", "peak_frame_no", "peak_motion_score", "candidate_count", "best_score", "low_quality", "quality_note"]
EVENT_SCHEMA = "start_frame_no int, end_frame_no int, best_frame_no int, peak_frame_no int, peak_motion_score double, candidate_count int, best_score double, low_quality boolean, quality_note string"


@dataclass(frozen=True)
class Settings:
    enter: int = 8  # quiet frames that make a scene stable
    leave: int = 5  # moving frames that end it
    sample_every: int = 3
    quick: int = 2  # quiet frames that are enough when motion comes back
    present_least: int = 1
    clarity: float = 0.6
    completeness: float = 0.4
    # of the tray machine
    still_pixels: int = 500
    sharp: float = 50.0
    window: int = 20
    leave_pixels: int = 1500
    leave_frames: int = 6
    same: float = 0.75
    food_pixels: int = 500


def _scaled(values: list[float]) -> list[float]:
    low, high = min(values), max(values)
    return [1.0] * len(values) if high - low < 1e-9 else [(v - low) / (high - low) for v in values]


def _passing(candidates: list[dict], multiplier: float, exposure: float) -> list[dict]:
    base = median(c["temporal_diff"] for c in candidates)
    limit = max(base * multiplier, base + 2.0)
    return [c for c in candidates if c["temporal_diff"] <= limit and c["exposure_outlier_ratio"] <= exposure]


def choose(candidates: list[dict], s: Settings) -> tuple[dict, float, bool, str]:
    """(best candidate, score, low quality, note): of those that pass the filters, else relaxed ones, else
    the one with the largest Laplacian (T8)."""
    pool, note = _passing(candidates, 1.8, 0.05), ""
    if not pool:
        pool, note = _passing(candidates, 2.5, 0.08), "relaxed_filters"
    if not pool:
        return max(candidates, key=lambda c: c["laplacian"]), 1.0, True, "fallback_laplacian_only"
    logs = [_scaled([math.log1p(max(0.0, c[f])) for c in pool]) for f in ("laplacian", "tenengrad", "local_clarity")]
    freq, whole = (_scaled([c[f] for c in pool]) for f in ("high_freq_ratio", "completeness"))
    clarity = [0.35 * a + 0.35 * b + 0.20 * c + 0.10 * d for a, b, c, d in zip(*logs, freq)]
    score = [s.clarity * c + s.completeness * w for c, w in zip(clarity, whole)]
    best = max(range(len(pool)), key=lambda i: (score[i], clarity[i], -pool[i]["edge_touch_ratio"], -pool[i]["center_distance_ratio"], -pool[i]["frame_no"]))
    return pool[best], score[best], bool(note), note


def new_state() -> dict:
    return {"stable": False, "quiet": 0, "moving": 0, "present": 0, "sampled": 0, "candidates": [], "start": None, "peak": 0.0, "peak_at": 0}


def _candidate(frame: dict) -> dict:
    return {k: frame.get(k) or 0.0 for k in ["frame_no", "motion_score", *FEATURES]}


def _event(state: dict, end: int, s: Settings, quick: bool) -> dict | None:
    if not state["candidates"] or state["start"] is None:
        return None
    best, score, low, note = choose(state["candidates"], s)
    before = state["peak"] >= best["motion_score"]
    return {
        "start_frame_no": state["start"],
        "end_frame_no": end,
        "best_frame_no": best["frame_no"],
        "peak_frame_no": state["peak_at"] if before else best["frame_no"],
        "peak_motion_score": max(state["peak"], best["motion_score"]),
        "candidate_count": len(state["candidates"]),
        "best_score": float(score),
        "low_quality": low or quick,
        "quality_note": "+".join(x for x in ("quick_stable_fallback" if quick else "", note) if x),
    }


def step(state: dict, frame: dict, s: Settings = Settings()) -> dict | None:
    """Takes one frame (frame_no, moving, present, motion_score and FEATURES); an event if one ends.

    While things move, candidates gather as long as something is present: the first of each run of
    present frames and each `sample_every` later. `enter` quiet frames make the scene stable, which the
    candidates then belong to; `leave` moving ones end it. If motion returns before, `quick` quiet frames
    are enough for an event of low quality.
    """
    no, moving, present, motion = frame["frame_no"], frame["moving"], frame["present"], frame["motion_score"]
    event = None
    if not state["stable"]:
        if moving:
            if state["quiet"] >= s.quick:
                event = _event(state, no - 1, s, quick=True)
            state.update(quiet=0, present=0, candidates=[], start=None, peak=0.0, peak_at=0)
            if motion >= 0.0:
                state.update(peak=motion, peak_at=no)
            return event
        state["quiet"] += 1
        if not present:
            state.update(present=0, candidates=[], start=None)
        else:
            state["present"] += 1
            if state["start"] is None:
                state["start"] = no
            if (state["present"] - 1) % s.sample_every == 0:
                state["candidates"].append(_candidate(frame))
        if state["quiet"] < s.enter:
            return None
        state.update(stable=True, moving=0, present=0, sampled=0)
        if state["start"] is None:
            state["start"] = max(0, no - s.enter + 1)
        if state["peak_at"] == 0:
            state["peak_at"] = no
        _sample(state, frame, s)
        return None
    _sample(state, frame, s)
    state["moving"] = state["moving"] + 1 if moving else 0
    if state["moving"] >= s.leave:
        event = _event(state, max(state["start"], no - s.leave), s, quick=False)
        state.update(new_state(), peak=motion, peak_at=no if motion > 0 else 0)
    return event


def _sample(state: dict, frame: dict, s: Settings) -> None:
    state["present"] = state["present"] + 1 if frame["present"] else 0
    due = state["sampled"] % s.sample_every == 0
    state["sampled"] += 1
    if due and frame["present"] and state["present"] >= s.present_least:
        state["candidates"].append(_candidate(frame))


def flush(state: dict, frame_no: int, s: Settings = Settings()) -> dict | None:
    """The event that the end of the frames ends (T5)."""
    if state["stable"]:
        event = _event(state, frame_no, s, quick=False)
    else:
        event = _event(state, frame_no, s, quick=True) if state["quiet"] >= s.quick else None
    state.update(new_state())
    return event


def new_tray() -> dict:
    return {"phase": "idle", "still": 0, "away": 0, "buffer": [], "start": None, "peak": 0.0, "peak_at": 0, "last": None, "last_food": 0}


def _alike(a: list[float] | None, b: list[float] | None) -> float:
    if not a or not b or len(a) != len(b):
        return 0.0
    x, y = sum(a) / len(a), sum(b) / len(b)
    top = sum((p - x) * (q - y) for p, q in zip(a, b))
    low = math.sqrt(sum((p - x) ** 2 for p in a) * sum((q - y) ** 2 for q in b))
    return top / low if low > 0 else 1.0


def tray_step(state: dict, frame: dict, s: Settings = Settings()) -> dict | None:
    """The tray machine (T6, T7): a tray locks after `enter` still frames if the sharpest of the last is
    sharp enough; a tray whose colours are those of the last one gives no event. It is gone when absent,
    or after `leave_frames` frames in a row with much motion. There is no flush.

    frame: frame_no, present, motion_pixels, motion_score, laplacian, histogram (of food colours),
    food_pixels.
    """
    no, present = frame["frame_no"], frame["present"]
    colours = frame.get("histogram")
    seen = {k: frame.get(k) for k in ("frame_no", "laplacian", "motion_score", "food_pixels")}
    state["buffer"] = [*state["buffer"], seen | {"histogram": None if colours is None else [float(x) for x in colours]}][-s.window :]

    def peak() -> None:
        if frame["motion_score"] >= state["peak"]:
            state.update(peak=frame["motion_score"], peak_at=no)

    def reset() -> None:
        state.update(phase="idle", still=0, away=0, buffer=[], start=None, peak=0.0, peak_at=0)

    if state["phase"] == "idle":
        if present:
            state.update(phase="locking", still=0, buffer=[], start=no, peak=frame["motion_score"], peak_at=no)
    elif state["phase"] == "locking":
        if not present:
            reset()
        elif frame["motion_pixels"] >= s.still_pixels:
            state["still"] = 0
            peak()
        else:
            state["still"] += 1
            peak()
            if state["still"] >= s.enter:
                best = max(state["buffer"][-s.enter :], key=lambda f: f["laplacian"] or 0.0)
                if (best["laplacian"] or 0.0) >= s.sharp:
                    food = best["food_pixels"] or 0
                    same = min(food, state["last_food"]) >= s.food_pixels and _alike(best["histogram"], state["last"]) > s.same
                    state.update(phase="done" if same else "locked", away=0, last=best["histogram"], last_food=food)
                    if not same:
                        return {
                            "start_frame_no": state["start"], "end_frame_no": no, "best_frame_no": best["frame_no"],
                            "peak_frame_no": state["peak_at"], "peak_motion_score": max(state["peak"], frame["motion_score"]),
                            "candidate_count": len(state["buffer"]), "best_score": float(best["laplacian"]), "low_quality": False,
                            "quality_note": "tray_selector",
                        }
    elif state["phase"] == "locked":
        state["phase"] = "done"
    elif not present:
        reset()
    elif frame["motion_pixels"] > s.leave_pixels:
        state["away"] += 1
        if state["away"] >= s.leave_frames:
            reset()
    else:
        state["away"] = 0
    return None
