"""Assignments in which an earlier choice limits later ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.operators.nearest import nearest_in_band
from larder.sources.scratch import Scratch, small

_SENT = 20_000  # rows of a table that a round sends through the driver: there may be many rounds
_CHUNK = 32_768  # records and images, about, that a task takes in turn
_CROWD = 65_536  # images near a bucket of records, beyond which a chunk isn't taken in turn by one task


def exclusive_match(records: DataFrame, images: DataFrame, seconds: float = 1.0, price_tolerance: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """(record_id, image_id, status, time_diff, price_diff), one row per record: as nearest_match, but an
    image that a record matched is gone for later ones; images matched by time alone stay (J2).

    records: (record_id long, record_time, amount), images: (image_id long, image_time, total), and `by` in
    both. Records go by time, then id. Images of one id are one image, within `by`.

    Time is cut into chunks of about `_CHUNK` rows, and a task takes a chunk's records in turn. What they take
    concerns later chunks only by images that stand in both. So all chunks go at once, and those that find
    other images gone than they knew of go again, until none does. The first chunk is right from the start,
    the next once it knows what the first took, and so on; mostly two rounds are enough. A chunk with more
    than `_CROWD` images near a bucket is settled in rounds of its own, see `_in_rounds`.
    """
    by = by or []
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    scratch, within = Scratch(records.sparkSession), int(seconds * 1_000_000)
    width = max(within, 1_000_000)
    columns = lambda key, at, value: (*by, F.col(key).cast("long").alias("id"), micros(at).alias("at"), F.col(value).cast("double").alias("value"))
    bucket = F.expr(f"(at - pmod(at, {width}L)) div {width}L")
    r = scratch.put(records.select(*columns("record_id", "record_time", "amount")).withColumn("bucket", bucket), "records")
    i = scratch.put(images.select(*columns("image_id", "image_time", "total")).withColumn("bucket", bucket), "images")
    takes_part = F.lit(True)
    for c in (*by, "id", "at"):
        takes_part = takes_part & F.col(c).isNotNull()
    keys = [*by, "chunk"]
    dealt = _dealt(scratch, r.where(takes_part), i.where(takes_part), by)
    crowds = not dealt.where("crowded").isEmpty()
    pictures = dealt.where("NOT is_record").select(*keys, "id")
    in_many = pictures.groupBy(*by, "id").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).where("a < b").drop("a", "b")
    shared = scratch.put(pictures.join(small(scratch.put(in_many, "in_many"), _SENT), [*by, "id"], "left_semi").distinct(), "shared")
    rounds, again, gone = [], None, None
    while True:
        some = dealt if again is None else dealt.join(small(again, _SENT), keys, "left_semi")
        if gone is not None:
            out = gone.select(*keys, "id").distinct().withColumns({"is_record": F.lit(False), "gone": F.lit(True)})
            out = small(scratch.put(out, "out"), _SENT)
            some = some.join(out, [*keys, "is_record", "id"], "left_anti")
        found = _in_turn(some.where("NOT crowded"), keys, within, price_tolerance)
        if crowds:
            found = found.unionByName(_in_rounds(scratch, some.where("crowded"), keys, seconds, price_tolerance))
        found = scratch.put(found, f"found-{len(rounds)}")
        rounds.append((found, again))
        now = found.where("matched").select(*by, F.col("chunk").alias("taken_in"), F.col("image").alias("id"))
        now = now.join(small(shared, _SENT), [*by, "id"]).where("chunk > taken_in").select(*keys, "id", "taken_in")
        if gone is not None:
            now = now.unionByName(gone.join(small(again.withColumnRenamed("chunk", "taken_in"), _SENT), [*by, "taken_in"], "left_anti").select(*now.columns))
        now = scratch.put(now, f"gone-{len(rounds) % 2}")  # `gone` is still read below
        here = lambda df, c: df.select(*keys, "id").distinct().withColumn(c, F.lit(True))
        changed = here(now, "now") if gone is None else here(now, "now").join(here(gone, "before"), [*keys, "id"], "full_outer").where("now IS NULL OR before IS NULL")
        again, gone = scratch.put(changed.select(*keys).distinct(), f"again-{len(rounds)}"), now
        if again.isEmpty():
            break
    return _told(scratch, r.where(~takes_part), rounds, keys)


def _told(scratch: Scratch, others: DataFrame, rounds: list[tuple[DataFrame, DataFrame | None]], keys: list[str]) -> DataFrame:
    """What each chunk found when it last went; `others` take no part."""
    out = rounds[0][0]
    if len(rounds) > 1:
        whole, went = None, None
        for n, (found, again) in enumerate(rounds):
            found = found.withColumn("turn", F.lit(n))
            whole = found if whole is None else whole.unionByName(found)
            if n:
                again = again.withColumn("turn", F.lit(n))
                went = again if went is None else went.unionByName(again)
        last = scratch.put(went.groupBy(*keys).agg(F.max("turn").alias("last")), "last")
        out = whole.join(small(last, _SENT), keys, "left").where(F.col("turn") == F.coalesce("last", F.lit(0)))
    status = F.when(F.col("image").isNull(), "unmatched_record").when(F.col("matched"), "matched").otherwise("time_matched_only")
    out = out.select(F.col("record").alias("record_id"), F.col("image").alias("image_id"), status.alias("status"), (F.col("time_diff") / 1_000_000).alias("time_diff"), "price_diff")
    none = {c: F.lit(None).cast(t) for c, t in (("image_id", "long"), ("time_diff", "double"), ("price_diff", "double"))}
    return out.unionByName(others.select(F.col("id").alias("record_id"), F.lit("unmatched_record").alias("status")).withColumns(none))


def _dealt(scratch: Scratch, r: DataFrame, i: DataFrame, by: list[str]) -> DataFrame:
    """Records and images (by, chunk, crowded, is_record, id, at, value), each record in its chunk, each image
    in those whose records may reach it. A chunk is named by its first bucket. Of a line of time, 65,536
    buckets at most are looked at together."""
    near = F.explode(F.sequence(F.col("bucket") - 1, F.col("bucket") + 1)).alias("bucket")
    rows = r.select(*by, "bucket", F.lit(1).alias("r"), F.lit(0).alias("i")).unionByName(i.select(*by, near, F.lit(0).alias("r"), F.lit(1).alias("i")))
    n = rows.groupBy(*by, "bucket").agg(F.sum("r").alias("r"), F.sum("i").alias("i")).where("r > 0").withColumn("span", F.shiftright("bucket", 16))
    upto = F.sum(F.col("r") + F.col("i") / 3).over(Window.partitionBy(*by, "span").orderBy("bucket"))
    part = Window.partitionBy(*by, "span", "part")
    chunks = n.withColumn("part", F.floor(upto / _CHUNK)).select(*by, "bucket", F.min("bucket").over(part).alias("chunk"), (F.max("i").over(part) > _CROWD).alias("crowded"))
    chunks = scratch.put(chunks, "chunks")
    reach = scratch.put(chunks.select(*by, near, "chunk", "crowded").distinct(), "reach")
    columns = [*by, "chunk", "crowded", "is_record", "id", "at", "value"]
    r = r.withColumns({"is_record": F.lit(True), "value": F.coalesce("value", F.lit(float("nan")))}).join(small(chunks, _SENT), [*by, "bucket"])
    i = i.withColumns({"is_record": F.lit(False), "value": F.nanvl(F.coalesce("value", F.lit(0.0)), F.lit(0.0))}).join(small(reach, _SENT), [*by, "bucket"])
    return scratch.put(r.select(columns).unionByName(i.select(columns)), "dealt")


class _Free:
    """Images of a chunk, and which of them are free. The value of one that is gone is infinite."""

    def __init__(self, at: np.ndarray, value: np.ndarray, ids: np.ndarray):
        order = np.lexsort((ids, at))
        self.at, self.value, self.ids = at[order], value[order].copy(), ids[order]
        self.free = np.ones(len(order), bool)
        _, self.of, count = np.unique(self.ids, return_inverse=True, return_counts=True)
        self.twice = bool((count > 1).any())

    def taken(self, at: np.ndarray, value: np.ndarray, micros: int, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of an image or -1, price difference, whether it was taken) of records in their order."""
        place, price, matched = [-1] * len(at), [np.nan] * len(at), [False] * len(at)
        low, high = np.searchsorted(self.at, at - micros, "left"), np.searchsorted(self.at, at + micros, "right")
        some = (high > low).nonzero()[0]
        values, free = self.value, self.free
        for n, a, b, t, v in zip(*(x.tolist() for x in (some, low[some], high[some], at[some], value[some]))):
            far = np.abs(values[a:b] - v)
            best = far.min()
            if best < np.inf:
                same = (far == best).nonzero()[0] + a
            else:  # none is free, or the record or an image has no finite value
                same = free[a:b].nonzero()[0] + a
                if not len(same):
                    continue
                if v == v:
                    far = np.abs(values[same] - v)
                    best = np.fmin.reduce(far)
                    same = same[far == best] if best == best else same
            if len(same) > 1:
                time = np.abs(self.at[same] - t)
                same = same[time == time.min()]
            one = int(same[self.ids[same].argmin()]) if len(same) > 1 else int(same[0])
            place[n] = one
            if v == v:
                price[n] = best
                if best <= most:
                    matched[n] = True
                    gone = self.of == self.of[one] if self.twice else one
                    free[gone], values[gone] = False, np.inf
        return np.array(place), np.array(price), np.array(matched)


def _in_turn(dealt: DataFrame, keys: list[str], micros: int, most: float) -> DataFrame:
    """(keys, record, image, matched, price_diff, time_diff in micros), a row per record: a task takes the
    records of a chunk by time, then id, holding its images."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, images, free = None, [], None
        for batch in batches:
            if not len(batch):
                continue
            new = np.zeros(len(batch), bool)
            for k in keys:
                c = batch.column(k)
                new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            at_first = tuple(batch.column(k)[0].as_py() for k in keys)
            new[0] = last != at_first
            last = tuple(batch.column(k)[-1].as_py() for k in keys)
            at, value, ids, is_record = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("at", "value", "id", "is_record"))
            size = len(batch)
            image, time, price, matched = np.full(size, -1), np.zeros(size, np.int64), np.full(size, np.nan), np.zeros(size, bool)
            has = np.zeros(size, bool)
            begins = np.unique(np.append(np.flatnonzero(new), 0))
            for a, b in zip(begins.tolist(), [*begins[1:].tolist(), size]):
                if new[a]:
                    images, free = [], None
                m = a + int(np.searchsorted(is_record[a:b], True))  # images stand before records
                if m > a:
                    images.append((at[a:m], value[a:m], ids[a:m]))
                if m == b or not images and free is None:
                    continue
                if free is None:
                    free, images = _Free(*(np.concatenate(c) for c in zip(*images))), []
                place, price[m:b], matched[m:b] = free.taken(at[m:b], value[m:b], micros, most)
                good = np.flatnonzero(place >= 0)
                place = place[good]
                has[m + good], image[m + good], time[m + good] = True, free.ids[place], np.abs(free.at[place] - at[m + good])
            r = np.flatnonzero(is_record)
            no_price = ~has | np.isnan(value)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(pa.array(r)) for k in keys), pa.array(ids[r]), pa.array(image[r], mask=~has[r]), pa.array(matched[r]), pa.array(price[r], mask=no_price[r]), pa.array(time[r], mask=~has[r])],
                names=[*keys, "record", "image", "matched", "price_diff", "time_diff"],
            )

    whole = dealt.select(*keys, "is_record", "at", "id", "value").repartitionByRange(*keys).sortWithinPartitions(*keys, "is_record", "at", "id")
    schema = dealt.select(*keys).schema.add("record", "long").add("image", "long").add("matched", "boolean").add("price_diff", "double").add("time_diff", "long")
    return whole.mapInArrow(of, schema)


def _in_rounds(scratch: Scratch, dealt: DataFrame, keys: list[str], seconds: float, most: float) -> DataFrame:
    """As _in_turn, for chunks too crowded for one task.

    All records ask at once for the best image that no earlier record has; the earliest that asks for an
    image has it, and who loses one asks again. Nobody passes over what it could have, and what is lost goes
    to an earlier record, so this ends where taking records one after another ends. In the end those without
    an image look for the nearest that was still there at their turn. Tables of more than `_SENT` rows are
    joined by shuffles, so the driver's share of a round is bounded.
    """
    dealt = scratch.put(dealt.select(*keys, "is_record", "id", "at", "value"), "crowds")
    r, i = dealt.where("is_record").drop("is_record"), dealt.where("NOT is_record").drop("is_record")

    def there(held: DataFrame | None) -> DataFrame:
        if held is None:
            return i.withColumns({c: F.lit(None).cast("long") for c in ("until_at", "until_id")})
        taken = held.select(*keys, F.col("image").alias("id"), "until_at", F.col("record").alias("until_id"))
        return i.join(small(taken, _SENT), [*keys, "id"], "left")

    held, asking, turn = None, r, 0
    while True:
        first = turn == 0
        times = asking.select(*keys, F.col("id").alias("record"), F.col("at").alias("until_at"))
        asked = nearest_in_band(asking, there(held), seconds, keys, most=most, few=not first, sent=_SENT).join(small(times, _SENT), "record")
        asked = asked.select(*keys, "image", "record", "until_at", "price_diff", "time_diff", F.lit(True).alias("new"))
        asked = scratch.put(asked, "asked")
        if not first and asked.isEmpty():
            break
        now = asked if held is None else held.withColumn("new", F.lit(False)).unionByName(asked.select(*held.columns, "new"))
        best = now.groupBy(*keys, "image").agg(F.min_by(F.struct("record", "until_at", "price_diff", "time_diff"), F.struct("until_at", "record")).alias("b")).select(*keys, "image", "b.*")
        # who asked or had an image, and has none now, asks again
        before = held
        held = scratch.put(best, f"held-{turn % 2}")  # `before` is still read below
        lost = asked.select("record") if before is None else asked.select("record").unionAll(before.select("record"))
        lost = scratch.put(lost.join(small(held.select("record"), _SENT), "record", "left_anti"), "lost")
        asking = scratch.put(r.join(small(lost, _SENT), F.col("id") == F.col("record"), "left_semi"), "asking")
        turn += 1
        if asking.isEmpty():
            break
    rest = r.join(small(held.select(F.col("record").alias("id")), _SENT), "id", "left_anti")
    near = nearest_in_band(rest, there(held), seconds, keys, sent=_SENT)
    columns = ["record", "image", "matched", "price_diff", "time_diff"]
    found = held.withColumn("matched", F.lit(True)).select(columns).unionByName(near.withColumn("matched", F.lit(False)).select(columns))
    found = small(scratch.put(found, "crowds_found"), _SENT)
    return r.select(*keys, F.col("id").alias("record")).join(found, "record", "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def rematched(previous: DataFrame, new: DataFrame, keep_confirmed: bool = False) -> DataFrame:
    """Matches after another run: new ones replace those of the same record, confirmed ones too unless
    `keep_confirmed`; a record that finds nothing keeps what it had; match_date stays (J3, J4)."""
    columns = ["image_id", "status", "time_diff", "price_diff"]
    p, n = previous.alias("p"), new.alias("n")
    both = p.join(n, "record_id", "full_outer")
    stays = F.col("p.status").isNotNull() & (F.col("n.status").isNull() | (F.col("n.status") == "unmatched_record"))
    if keep_confirmed:
        stays = stays | F.coalesce(F.col("p.status") == "confirmed", F.lit(False))
    return both.select(
        "record_id",
        *(F.when(stays, F.col(f"p.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in columns),
        F.coalesce("p.match_date", "n.match_date").alias("match_date"),
    )


def _overlap(a: dict, b: dict) -> float:
    if a["x1"] is None or b["x1"] is None or pd.isna(a["x1"]) or pd.isna(b["x1"]):
        return 0.0
    w = max(0.0, min(a["x2"], b["x2"]) - max(a["x1"], b["x1"]))
    h = max(0.0, min(a["y2"], b["y2"]) - max(a["y1"], b["y1"]))
    union = (a["x2"] - a["x1"]) * (a["y2"] - a["y1"]) + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) - w * h
    return w * h / union if union > 0 else 0.0


def suppressed(detections: DataFrame, key: str = "image_id", overlap: float = 0.6) -> DataFrame:
    """Detections (key, det_id, name, confidence, x1, y1, x2, y2) without duplicates.

    Best first (of equals, the smaller det_id): one goes if it overlaps a kept box by `overlap`, or has the
    name of a kept one, near it or apart. Detections of an image lie together,
    best first, so that a task walks them holding only what it kept of one image.
    """

    columns, key_at = detections.columns, detections.columns.index(key)
    name_at, corners = columns.index("name"), [columns.index(c) for c in ("x1", "y1", "x2", "y2")]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        image, kept = None, []
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                if row[key_at] != image:
                    image, kept = row[key_at], []
                box = dict(zip(("x1", "y1", "x2", "y2"), (row[c] for c in corners)))
                if all(k[0] != row[name_at] for k in kept) and all(_overlap(box, k[1]) < overlap for k in kept):
                    kept.append((row[name_at], box))
                    out.append(row)
            yield pd.DataFrame(out, columns=columns).astype(pdf.dtypes.to_dict())

    sorted_ = detections.repartition(key).sortWithinPartitions(key, F.desc("confidence"), "det_id")
    return sorted_.mapInPandas(of, detections.schema)


def best_by_name(dishes: DataFrame, key: str, name: str = "name", confidence: str = "confidence", tie: str = "det_id") -> DataFrame:
    """Of each name the row of highest confidence (of equals, the smallest tie key); blank names go."""
    w = Window.partitionBy(key, F.trim(name)).orderBy(F.desc(confidence), tie)
    return dishes.where(F.trim(F.coalesce(name, F.lit(""))) != "").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
