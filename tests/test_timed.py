"""Frames that come late, in any order and across a restart give the events of a batch."""

import random
from datetime import datetime, timedelta

import pytest

from larder.streaming import events, timed
from larder.streaming import machines as M

QUICK = M.Settings(enter=2, leave=2, sample_every=1)
SCHEMA = "channel_id string, frame_no int, ts timestamp, motion_score double, moving boolean, present boolean, " + ", ".join(f"{c} double" for c in M.FEATURES)
START = datetime(2024, 1, 5, 12)


def frames(channel, n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        moving = rng.random() < 0.35 if i % 17 > 2 else True
        out.append((channel, i, START + timedelta(seconds=i), 0.5 if moving else 0.01, moving, rng.random() < 0.8, *(float(rng.randrange(1, 50)) if c == "laplacian" else 0.5 for c in M.FEATURES)))
    return out


@pytest.fixture
def store(spark):
    timed.use_state_store(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def replay(spark, parts, folder):
    """One batch after another, each a run of its own from the same checkpoint."""
    source, out = str(folder / "in"), str(folder / "out")
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        found = timed.timed_events(stream, "ts", settings=QUICK, late="20 seconds", idle_ms=30_000)
        query = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(folder / "state")).outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    return sorted(map(tuple, spark.read.parquet(out).select("channel_id", *M.EVENT_COLUMNS).collect()))


def test_events_do_not_depend_on_arrival(spark, store, tmp_path):
    rows = frames("a", 60, 1) + frames("b", 50, 2)
    # far later, so that the watermark passes all others; its channel has no event
    mark = [("end", 0, START + timedelta(hours=1), 0.0, False, False, *[0.5] * len(M.FEATURES))]
    mark2 = [("end", 1, START + timedelta(hours=2), 0.0, False, False, *[0.5] * len(M.FEATURES))]
    want = sorted(tuple(r) for r in events.events(spark.createDataFrame(rows, SCHEMA).drop("ts"), settings=QUICK).select("channel_id", *M.EVENT_COLUMNS).collect())
    assert len(want) > 4
    ordered = sorted(rows, key=lambda r: r[2])
    late = ordered[:]
    for i in range(0, len(late) - 12, 12):  # within twelve rows, six seconds, in any order
        random.Random(i).shuffle(late[i : i + 12])
        late[i : i + 12] = late[i : i + 12][::-1]
    too_late = [("a", 100, START + timedelta(seconds=3), 0.9, True, True, *[0.5] * len(M.FEATURES))]
    one = replay(spark, [late[:40], late[40:75], late[75:], mark, too_late + mark2], tmp_path)
    assert one == want
