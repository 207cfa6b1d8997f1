"""Frames: the background mixture against a loop over pixels, masks and parts against loops, events from frames."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larder.functions import images as I
from larder.plans import queries as plans
from larder.streaming import background as B
from larder.streaming import events as E
from larder.streaming import machines as M


def plain_mixture(frames, rates, history, far):
    """One pixel after another, one mode after another; yields the masks."""
    modes = [[] for _ in range(frames[0][..., 0].size)]  # [weight, mean, variance], heaviest first
    for n, (frame, rate) in enumerate(zip(frames, rates), 1):
        a = 1 / min(2 * n, history) if rate < 0 or n == 1 else rate
        out = []
        for own, x in zip(modes, frame.reshape(len(modes), -1).astype(float)):
            back, fit, total = False, None, 0.0
            for m in list(own):
                m[0] = (1 - a) * m[0] - a * 0.05
                if fit is None:
                    d = float(((m[1] - x) ** 2).sum())
                    if total < 0.9 and d < far * m[2]:
                        back = True
                    if d < 9 * m[2]:
                        fit = m
                        m[0] += a
                        k = a / m[0]
                        m[1] = m[1] + k * (x - m[1])
                        m[2] = min(max(m[2] + k * (d - m[2]), 4.0), 75.0)
                if m[0] < a * 0.05:
                    own[:] = [o for o in own if o is not m]
                else:
                    total += m[0]
            for m in own:
                m[0] /= total
            if fit is None and a > 0:
                if len(own) == 5:
                    own.pop()
                for m in own:
                    m[0] *= 1 - a
                fit = [a if own else 1.0, x, 15.0]
                own.append(fit)
            own.sort(key=lambda m: (-m[0], m is not fit))
            out.append(not back)
        yield np.array(out).reshape(frame.shape[:2])


@pytest.mark.parametrize("channels", [1, 3])
def test_mixture_against_a_loop_over_pixels(channels):
    rng = np.random.default_rng(1)
    base = rng.integers(40, 200, (6, 7, channels))
    frames, rates = [], []
    for i in range(70):
        x = base + rng.normal(0, 4, base.shape)
        x[rng.random(base.shape[:2]) < 0.15] = rng.integers(0, 255, channels)
        frames.append(np.clip(x, 0, 255).astype(np.uint8))
        rates.append(0.0 if 30 <= i < 40 else 0.05 if i % 7 == 0 else -1.0)
    model = B.Mixture(history=20, far=16.0)
    for i, (want, frame, rate) in enumerate(zip(plain_mixture(frames, rates, 20, 16.0), frames, rates)):
        assert (model.apply(frame, rate) == want).all(), i
    assert ((model.weight > 0).sum(axis=1) > 1).any()


def plain_parts(mask):
    seen, out, n = set(), np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask)):
        if (y, x) in seen:
            continue
        n += 1
        stack = [(y, x)]
        seen.add((y, x))
        while stack:
            a, b = stack.pop()
            out[a, b] = n
            for c in (a - 1, a, a + 1):
                for d in (b - 1, b, b + 1):
                    if 0 <= c < mask.shape[0] and 0 <= d < mask.shape[1] and mask[c, d] and (c, d) not in seen:
                        seen.add((c, d))
                        stack.append((c, d))
    return out


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(0, 10**9), st.floats(0, 1))
def test_parts_and_masks_against_loops(h, w, seed, share):
    mask = np.random.default_rng(seed).random((h, w)) < share
    label = plain_parts(mask)
    assert (I.components(mask) == label).all()
    near = lambda y, x, r: [mask[a, b] for a in range(y - r, y + r + 1) for b in range(x - r, x + r + 1) if 0 <= a < h and 0 <= b < w]
    assert (I.dilated(mask, 3) == [[any(near(y, x, 1)) for x in range(w)] for y in range(h)]).all()
    assert (I.eroded(mask, 4) == [[all(near(y, x, 2)) for x in range(w)] for y in range(h)]).all()
    kept, area, box = I.large_parts(mask, 3)
    areas = np.bincount(label.ravel())[1:]
    assert area == max([0, *areas[areas >= 3]]) and (box is None) == (area == 0)
    assert kept.sum() == areas[areas >= 3].sum()


def test_blur_grey_and_hue():
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (5, 6)).astype(np.uint8)
    weights, mirrored = [1, 4, 6, 4, 1], lambda i, n: -i if i < 0 else 2 * n - 2 - i if i >= n else i
    for y in range(5):
        for x in range(6):
            total = sum(a * b * int(image[mirrored(y + i - 2, 5), mirrored(x + j - 2, 6)]) for i, a in enumerate(weights) for j, b in enumerate(weights))
            assert I.blurred(image)[y, x] == (total + 128) // 256
    assert I.blurred(np.full((1, 1), 7, np.uint8), 9)[0, 0] == 7
    assert I.grey(np.full((2, 2, 3), 100, np.uint8)).tolist() == [[100, 100], [100, 100]]
    colours = {(0, 0, 255): (0, 255, 255), (0, 255, 0): (60, 255, 255), (255, 0, 0): (120, 255, 255), (0, 128, 255): (15, 255, 255), (9, 9, 9): (0, 0, 9), (255, 0, 255): (150, 255, 255), (9, 0, 255): (179, 255, 255)}
    for bgr, want in colours.items():
        assert tuple(I.hsv(np.array([[bgr]], np.uint8))[0, 0]) == want


def test_frames_give_motion_foreground_and_events(spark):
    """A square comes to rest before a still background, then leaves; a channel a length, one with odd frames."""
    rows, still, t = [], np.full((12, 12), 60, np.uint8), 200  # so many frames make the background firm
    for channel, n in (("a", t + 40), ("b", t + 55)):
        for i in range(n):
            frame = still.copy()
            if t + 12 <= i < t + 30:
                x = min(i - t - 10, 4)
                frame[3:9, x : x + 6] = 200
            rows.append((channel, i, 12, frame.tobytes()))
    rows += [("odd", 0, None, None), ("odd", 1, 12, b""), ("odd", 2, 5, bytes(12)), ("odd", 3, 12, bytes(144))]
    df = spark.createDataFrame(rows, "channel_id string, frame_no int, width int, pixels binary")
    view = B.View(least_area=10, least_share=0.1, open=1, close=1)
    found = {(r["channel_id"], r["frame_no"]): r for r in B.foreground(df, view=view).collect()}
    moved = {(r["channel_id"], r["frame_no"]): r for r in B.motion_scores(df, view=view).collect()}
    assert len(found) == len(moved) == len(rows)
    # before the first frame there is no background
    assert [i for i in range(t + 40) if found["a", i]["present"]] == [0, *range(t + 12, t + 30)]
    here = found["a", t + 20]
    assert (here["x"], here["y"], here["w"], here["h"], here["largest_area"], here["edge_touch_ratio"]) == (4, 3, 6, 6, 36, 0.0)
    assert {i for i in range(t + 40) if moved["a", i]["moving"]} == {t + 12, t + 13, t + 14, t + 30}
    assert [found["odd", i]["fg_pixels"] for i in range(3)] == [0, 0, 10] and moved["odd", 3]["motion_score"] == 0.0
    events = B.video_events(df, view=view, settings=M.Settings(enter=3, leave=1, sample_every=1)).where("channel_id <> 'odd'").collect()
    assert {r["channel_id"] for r in events} == {"a", "b"}
    assert any(t + 14 <= r["start_frame_no"] and r["end_frame_no"] <= t + 30 for r in events)


def test_frozen_frames_do_not_teach(spark):
    rows = [("a", i, 10, bytes([50] * 100) if i < 5 else bytes([200] * 100), "update" if i < 5 else "freeze") for i in range(300)]
    df = spark.createDataFrame(rows, "channel_id string, frame_no int, width int, pixels binary, mode string")
    view = B.View(least_area=10, open=1, close=1, history=10)
    assert B.foreground(df, view=view, mode="mode").where("present").count() == 296  # the first one, too
    assert B.foreground(df, view=view).where("present").count() < 100


def test_the_query_equals_plain_loops(spark, sf_dir):
    found = {(r["channel_id"], r["frame_no"]): (r["fg_pixels"], r["largest_area"]) for r in plans.QUERIES["background_scan"](spark, sf_dir).collect()}
    vectors = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect())
    channels = {}
    for i, v in vectors:
        channels.setdefault(i // 100, []).append(np.clip(np.floor(np.array(v, dtype=np.float64) * 256 + 128), 0, 255).astype(np.uint8).reshape(8, 8, 1))
    for c, frames in channels.items():
        for no, mask in enumerate(plain_mixture(frames, [-1.0] * len(frames), 50, 16.0)):
            label = plain_parts(I.cleaned(mask, 1, 3))
            areas = np.bincount(label.ravel())[1:]
            assert found[c, no] == (areas[areas >= 4].sum(), max([0, *areas[areas >= 4]]))
    assert len(found) == len(vectors) and len({x for x, _ in found.values()}) > 5


def tray_frame(i, colour=(40, 160, 60), at=8):
    """A still orange tray with food of one colour on it, in the dark; skin passes in frame 6."""
    frame = np.full((40, 40, 3), 30, np.uint8)
    if 3 <= i < 14:
        frame[at : at + 24, 8:32] = (20, 120, 240)
        frame[14:26, 14:26] = colour
        frame[15:25:2, 15:25] = 0  # sharp lines
    if i == 6:
        frame[8:12, 8:20] = (120, 160, 230)
    return frame


def test_trays_are_found_in_frames(spark):
    other = (200, 60, 60)
    frames = {"a": [tray_frame(i) for i in range(16)], "b": [tray_frame(i) for i in range(16)] + [tray_frame(i, other) for i in range(16)], "c": [tray_frame(i) for i in range(16)] * 2}
    rows = [(c, i, 40, 3, f.tobytes()) for c, fs in frames.items() for i, f in enumerate(fs)] + [("d", 0, 40, 3, None), ("d", 1, 0, 3, b"x"), ("d", 2, 40, 1, bytes(1600))]
    df = spark.createDataFrame(rows, "channel_id string, frame_no int, width int, channels int, pixels binary")
    found = B.tray_features(df).cache()
    seen = {(r["channel_id"], r["frame_no"]): r for r in found.collect()}
    assert len(seen) == len(rows)
    assert [i for i in range(16) if seen["a", i]["present"]] == list(range(3, 14))
    assert seen["a", 3]["motion_pixels"] > 200 and seen["a", 5]["motion_pixels"] == 0 and seen["a", 9]["laplacian"] > 50
    assert seen["a", 6]["motion_pixels"] == 0 < seen["a", 7]["motion_pixels"]  # skin hides motion where it is, not where it was
    food = seen["a", 9]
    assert food["food_pixels"] == 12 * 12 - 5 * 10 == sum(food["histogram"])
    assert [seen["d", i]["present"] for i in range(3)] == [False] * 3 and seen["d", 0]["histogram"] is None
    events = E.events(found, kind="tray_selector", settings=M.Settings(enter=3, sharp=10.0, food_pixels=20)).groupBy("channel_id").count().collect()
    assert {r["channel_id"]: r["count"] for r in events} == {"a": 1, "b": 2, "c": 1}  # the same tray twice counts once
