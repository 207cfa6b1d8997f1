"""The nearest by value among those near in time, by an index instead of pairs.

Images stand in their bucket of time and both neighbours, records in their own: buckets are as wide as the
band, so one bucket holds all that a record can meet. A task walks buckets in order. It sorts a bucket's
images by value, and each record looks outward from its own value until nothing further out can be nearer.
What is written for a record doesn't depend on how dense its band is, and a crowded bucket is dealt into
slices of images, which a record looks at one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.sources.scratch import Scratch, small

FOUND = "record long, image long, price_diff double, time_diff long"
_FREE = np.iinfo(np.int64).max


def _nearest(images: dict, records: dict, micros: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place of the record, place of the image, difference of value, of time) of each record that finds one.

    Both are dicts of arrays: group, at (micros), value, id; images until_at and until_id as well: from that
    record on (by time, then id) they are gone. Records without a value (NaN) take all images as equally near.
    """
    order = np.lexsort((images["value"], images["group"]))
    im = {k: v[order] for k, v in images.items()}
    n, m = len(order), len(records["group"])
    begin, end = (np.searchsorted(im["group"], records["group"], side=s) for s in ("left", "right"))
    group, value = np.concatenate((im["group"], records["group"])), np.concatenate((im["value"], records["value"]))
    both = np.lexsort((np.arange(n + m) >= n, value, group))
    place = np.empty(n + m, np.int64)
    place[both] = np.cumsum(both < n)
    middle = np.clip(place[n:], begin, end)
    best = np.full(m, -1)
    best_price, best_time = np.full(m, np.inf), np.full(m, _FREE)
    open_, reach = np.flatnonzero(end > begin), 8
    while len(open_):
        later = []
        for at in range(0, len(open_), max(1, (1 << 20) // reach)):
            r = open_[at : at + max(1, (1 << 20) // reach)]
            j = middle[r][:, None] + np.arange(-reach, reach)
            inside = (j >= begin[r][:, None]) & (j < end[r][:, None])
            j = np.where(inside, j, 0)
            no_value = np.isnan(records["value"][r])
            price = np.where(no_value[:, None], 0.0, np.abs(im["value"][j] - records["value"][r][:, None]))
            time = np.abs(im["at"][j] - records["at"][r][:, None])
            until, own = im["until_at"][j], records["at"][r][:, None]
            good = inside & (time <= micros) & ((until > own) | (until == own) & (im["until_id"][j] > records["id"][r][:, None]))
            price = np.where(good, price, np.inf)
            low = price.min(axis=1)
            time = np.where(price == low[:, None], np.where(good, time, _FREE), _FREE)
            soon = time.min(axis=1)
            id_ = np.where((time == soon[:, None]) & good, im["id"][j], _FREE)
            first = id_.argmin(axis=1)
            left, right = middle[r] - reach, middle[r] + reach
            gap = np.minimum(
                np.where(left > begin[r], records["value"][r] - im["value"][np.maximum(left - 1, 0)], np.inf),
                np.where(right < end[r], im["value"][np.minimum(right, n - 1)] - records["value"][r], np.inf),
            )  # how near what lies further out can be
            gap = np.where(no_value & ((left > begin[r]) | (right < end[r])), 0.0, gap)
            sure = (low < gap) | ((left <= begin[r]) & (right >= end[r]))
            hit = sure & np.isfinite(low)
            best[r[hit]], best_price[r[hit]], best_time[r[hit]] = j[np.flatnonzero(hit), first[hit]], low[hit], soon[hit]
            later.append(r[~sure])
        open_, reach = np.concatenate(later), reach * 4
    found = np.flatnonzero(best >= 0)
    price = np.where(np.isnan(records["value"][found]), np.nan, best_price[found])
    return found, order[best[found]], price, best_time[found]


def _claimed(images: dict, records: dict, micros: int, most: float) -> tuple[np.ndarray, ...]:
    """As _nearest, for images no further than `most` in value, each of which goes to one record: to the
    earliest that wants it. Records that lose theirs look again, until none does. `until` of images is set
    to who has them, so nobody later sees them."""
    m = len(records["id"])
    image, price, time = np.full(m, -1), np.zeros(m), np.zeros(m, np.int64)
    has, open_ = np.full(len(images["id"]), -1), np.arange(m)
    while len(open_):
        at, want, far, late = _nearest(images, {c: v[open_] for c, v in records.items()}, micros)
        good = far <= most
        r, want, far, late = open_[at[good]], want[good], far[good], late[good]
        order = np.lexsort((records["id"][r], records["at"][r], want))
        first = order[np.diff(want[order], prepend=-1) != 0]
        lost = np.setdiff1d(r, r[first], assume_unique=True)
        r, want = r[first], want[first]
        before = has[want]
        before = before[before >= 0]
        image[before] = -1
        image[r], price[r], time[r], has[want] = want, far[first], late[first], r
        images["until_at"][want], images["until_id"][want] = records["at"][r], records["id"][r]
        open_ = np.concatenate((lost, before))
    found = np.flatnonzero(image >= 0)
    return found, image[found], price[found], time[found]


def _walk(keys: list[str], micros: int, most: float | None):
    """Batches of images and records, sorted by `keys` with images first and records by time, to rows of
    FOUND. The images of a group that goes on in the next batch are held. With `most`, records of a group
    that isn't dealt into slices compete for images."""
    names = ("at", "value", "id", "until_at", "until_id", "alone")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, number = None, None, -1
        for batch in batches:
            if not len(batch):
                continue
            new = np.zeros(len(batch), bool)
            for k in keys:
                c = batch.column(k)
                new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            new[0] = last != tuple(batch.column(k)[0].as_py() for k in keys)
            x = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names} | {"group": number + np.cumsum(new)}
            last, number = tuple(batch.column(k)[-1].as_py() for k in keys), int(x["group"][-1])
            is_record = batch.column("is_record").to_numpy(zero_copy_only=False)
            images, records = {c: v[~is_record] for c, v in x.items()}, {c: v[is_record] for c, v in x.items()}
            if held is not None:
                images = {c: np.concatenate((held[c], v)) for c, v in images.items()}
            found = []
            for alone in (False, True) if most is not None else (False,):
                one = (np.flatnonzero(y["alone"] == alone) if most is not None else np.arange(len(y["id"])) for y in (images, records))
                i, r = one
                some, own = ({c: v[at] for c, v in y.items()} for y, at in ((images, i), (records, r)))
                at, image, price, time = _claimed(some, own, micros, most) if alone else _nearest(some, own, micros)
                if alone:
                    images["until_at"][i], images["until_id"][i] = some["until_at"], some["until_id"]
                found.append((r[at], i[image], price, time))
            at, image, price, time = (np.concatenate(c) for c in zip(*found))
            yield pa.RecordBatch.from_arrays(
                [pa.array(records["id"][at]), pa.array(images["id"][image]), pa.array(price, mask=np.isnan(price)), pa.array(time)],
                names=["record", "image", "price_diff", "time_diff"],
            )
            held = {c: v[images["group"] == number] for c, v in images.items()}

    return of


def nearest_in_band(
    records: DataFrame, images: DataFrame, seconds: float, by: list[str] | None = None, slice_rows: int = 65_536, most: float | None = None, few: bool = False, sent: int = 200_000
) -> DataFrame:
    """(record, image, price_diff, time_diff in micros): for each record the image within `seconds` of it
    (both ends included) whose value is nearest; of equals the nearer in time, then the smaller id.

    records: (id long, at micros, value double), images: the same and until_at, until_id, null if they don't
    end; `by` in both must agree, and nulls agree with nothing. Records that find nothing have no row. A
    record without a value is equally near to all images, with a null price_diff; an image without counts
    as 0. Ids of records must differ.

    With `most`, only images no further in value are found, and a record doesn't find what an earlier one of its bucket does.
    `few` says that there are few records, so that images out of their reach are left out first.
    Tables of buckets of at most `sent` rows are broadcast.
    """
    by, micros = by or [], int(seconds * 1_000_000)
    width = max(micros, 1_000_000)
    scratch = Scratch(records.sparkSession)
    whole = lambda df: df.where(F.col("at").isNotNull() & F.col("id").isNotNull()).dropna(subset=by) if by else df.where("at is not null and id is not null")
    bucket = F.floor(F.col("at") / width)
    end = lambda c: F.coalesce(F.col(c), F.lit(int(_FREE)))
    i = whole(images).select(*by, "id", "at", F.nanvl(F.coalesce("value", F.lit(0.0)), F.lit(0.0)).alias("value"), end("until_at").alias("until_at"), end("until_id").alias("until_id"))
    i = i.withColumn("bucket", F.explode(F.sequence(bucket - 1, bucket + 1)))
    crowded = i.groupBy(*by, "bucket").agg(F.ceil(F.count("*") / slice_rows).cast("int").alias("slices")).where("slices > 1")
    crowded = small(scratch.put(crowded, "crowded"), sent)
    dealt = lambda df: df.join(crowded, [*by, "bucket"], "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    if few:
        near = scratch.put(whole(records).select(*by, bucket.alias("bucket")).distinct(), "buckets")
        i = i.join(small(near, sent), [*by, "bucket"], "left_semi")
    i = dealt(i).withColumn("slice", F.pmod(F.xxhash64("id"), "slices").cast("int"))
    r = whole(records).select(*by, "id", "at", F.coalesce("value", F.lit(float("nan"))).alias("value"), F.lit(0).cast("long").alias("until_at"), F.lit(0).cast("long").alias("until_id"), bucket.alias("bucket"))
    r = dealt(r).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    columns = [*by, "bucket", "slice", (F.col("slices") == 1).alias("alone"), "id", "at", "value", "until_at", "until_id"]
    both = i.select(*columns, F.lit(False).alias("is_record")).unionByName(r.select(*columns, F.lit(True).alias("is_record")))
    keys = [*by, "bucket", "slice"]
    both = both.repartition(*keys).sortWithinPartitions(*keys, "is_record", "at", "id")
    found = both.mapInArrow(_walk(keys, micros, most), FOUND)
    if most is not None:
        found = found.where(F.col("price_diff") <= most)
    best = found.groupBy("record").agg(F.min(F.struct(F.coalesce("price_diff", F.lit(0.0)).alias("p"), "time_diff", "image", "price_diff")).alias("m"))
    return best.select("record", "m.image", "m.price_diff", "m.time_diff")
