"""The event machines on known frame sequences, and the streamed form against the batch form."""

import pytest
from pyspark.sql import functions as F

from larder.streaming import events
from larder.streaming import machines as M

QUICK = M.Settings(enter=2, leave=2, sample_every=1)
FIELDS = ", ".join(f"{c} double" for c in M.FEATURES)


def frames(motion, present, threshold=0.1):
    return [{"frame_no": i, "motion_score": m, "moving": m >= threshold, "present": p, **dict.fromkeys(M.FEATURES, 0.5), "laplacian": float(i)} for i, (m, p) in enumerate(zip(motion, present))]


def run(sequence, settings=QUICK):
    state = M.new_state()
    return [e for f in sequence if (e := M.step(state, f, settings))]


@pytest.mark.parametrize(
    "motion, present, settings, start",
    [
        ([0.30, 0.02, 0.01, 0.02, 0.18, 0.22], [0, 1, 1, 1, 1, 1], QUICK, 1),
        ([0.02, 0.01, 0.20, 0.22], [0, 0, 0, 0], QUICK, None),
        ([0.02, 0.01, 0.20, 0.22], [1, 1, 1, 1], QUICK, 0),
        ([0.28, 0.02, 0.01, 0.21], [0, 1, 1, 1], M.Settings(enter=5, leave=2, sample_every=1), 1),
    ],
)
def test_sequences(motion, present, settings, start):
    found = run(frames(motion, map(bool, present)), settings)
    assert [e["start_frame_no"] for e in found] == ([] if start is None else [start])
    if settings.enter == 5:
        assert found[0]["quality_note"].startswith("quick_stable_fallback") and found[0]["low_quality"]
    elif found:
        assert found[0]["candidate_count"] >= 2


def test_tray_locks_and_leaves():
    state, s = M.new_tray(), M.Settings(enter=2)
    frame = lambda no, present, pixels=0: {"frame_no": no, "present": present, "motion_pixels": pixels, "motion_score": 0.0, "laplacian": 90.0, "histogram": [1.0, 2.0], "food_pixels": 900}
    found = [e for f in [frame(0, False), frame(1, True), frame(2, True), frame(3, True)] if (e := M.tray_step(state, f, s))]
    assert len(found) == 1 and found[0]["quality_note"] == "tray_selector"
    M.tray_step(state, frame(4, True), s)
    for i in range(s.leave_frames):
        M.tray_step(state, frame(5 + i, True, 5000), s)
    assert state["phase"] == "idle"


def test_chooser():
    base = {c: 1.0 for c in M.FEATURES} | {"exposure_outlier_ratio": 0.0, "temporal_diff": 1.0, "motion_score": 0.0}
    sharp, blurred = base | {"frame_no": 2, "laplacian": 900.0, "tenengrad": 900.0, "local_clarity": 90.0}, base | {"frame_no": 1}
    best, _, low, _ = M.choose([blurred, sharp], QUICK)
    assert best["frame_no"] == 2 and not low
    bad = base | {"frame_no": 1, "exposure_outlier_ratio": 1.0, "temporal_diff": 50.0}
    assert M.choose([bad], QUICK)[2:] == (True, "fallback_laplacian_only")


def test_stream_equals_batch(spark, tmp_path):
    rows = [{"channel_id": c, **f} for c in ("a", "b") for f in frames([0.3, 0.02, 0.01, 0.02, 0.18, 0.22, 0.01, 0.01, 0.02], [c == "a" or i % 4 > 0 for i in range(9)])]
    schema = f"channel_id string, frame_no int, motion_score double, moving boolean, present boolean, {FIELDS}, end_of_video boolean"
    names = [x.split()[0] for x in schema.split(", ")]
    ends = [{"channel_id": c, "frame_no": 9, "end_of_video": True} for c in ("a", "b")]
    table = lambda part: spark.createDataFrame([tuple(r.get(n) for n in names) for r in part], schema)
    batch = events.events(table(rows).drop("end_of_video"), settings=QUICK)
    source = str(tmp_path / "in")
    for part in ([r for r in rows if r["frame_no"] < 4], [r for r in rows if r["frame_no"] >= 4], ends):
        table(part).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        query = (
            events.event_stream(stream, settings=QUICK).writeStream.outputMode("append").format("parquet")
            .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start()
        )
        assert query.awaitTermination(60)
    columns = ["channel_id", *M.EVENT_COLUMNS]
    found = spark.read.parquet(str(tmp_path / "out")).select(columns).orderBy(*columns[:3]).collect()
    assert found and found == batch.select(columns).orderBy(*columns[:3]).collect()


def test_matched_stream_has_the_band(spark, tmp_path):
    base = spark.range(5).select(F.col("id").alias("record_id"), F.timestamp_seconds(F.col("id") * 10 + 1_700_000_000).alias("record_time"), F.lit(1.0).alias("amount"))
    near = spark.range(5).select(F.col("id").alias("image_id"), F.timestamp_seconds(F.col("id") * 10 + F.col("id") % 2 * 5 + 1_700_000_000).alias("image_time"), F.lit(1.0).alias("total"))
    base.write.parquet(str(tmp_path / "r"))
    near.write.parquet(str(tmp_path / "i"))
    streams = [spark.readStream.schema(d.schema).parquet(str(tmp_path / p)) for d, p in ((base, "r"), (near, "i"))]
    query = events.matched_stream(*streams).writeStream.format("memory").queryName("matched").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r["record_id"], r["image_id"]) for r in spark.table("matched").collect()) == [(0, 0), (2, 2), (4, 4)]
