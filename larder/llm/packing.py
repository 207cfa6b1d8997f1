"""Best-fit packing of token pieces into sequences by minimum bin slack.

Texts are tokenised where they lie and leave their tasks as pieces: lengths and checksums, no ids.
Bins depend on lengths alone, and lengths are at most the sequence length. So a histogram of at most
`size` numbers is all that the bin search needs, however many pieces there are; what it returns is a
list of fillings with repeat counts, whose size is bounded too. Pieces then find their places by rank
within their length.
"""

from __future__ import annotations

import base64
import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from larder.llm.common import handed_back, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
END_ID = 2
_coders: dict[tuple, object] = {}


def _tokenizer(json_file: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(json_file)


def _coder(json_file: str, rank_file: str | None, pattern: str | None):
    """text -> ids, as tokenizers gives them for `json_file`. The rank file holds the same vocabulary and
    merges for tiktoken, which gives the same ids some three times as fast; texts that hold the string of
    a special token, or that tiktoken can't take, go to tokenizers."""
    key = (json_file, rank_file)
    if key not in _coders:
        with open(json_file, encoding="utf-8") as f:
            special = [t["content"] for t in json.load(f)["added_tokens"]]
        whole = functools.cache(lambda: _tokenizer(json_file))  # some 30 MB, which few texts need
        slow = lambda x: np.array(whole().encode(x, add_special_tokens=False).ids, dtype=np.uint32)
        if rank_file is None:
            _coders[key] = slow
        else:
            import tiktoken

            with open(rank_file, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
            fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

            def ids(x: str) -> np.ndarray:
                if any(s in x for s in special):
                    return slow(x)
                try:
                    return fast.encode_to_numpy(x, disallowed_special=())
                except (KeyboardInterrupt, SystemExit, GeneratorExit):
                    raise
                except BaseException:  # a panic of its matcher on some long inputs is no Exception
                    return slow(x)

            _coders[key] = ids
    return _coders[key]


def token_pieces(
    docs: DataFrame, json_file: str, rank_file: str | None, pattern: str | None, size: int = 1024
) -> DataFrame:
    """PIECES of every row of `docs` (doc_id long, text string): its ids and then END_ID, cut into pieces
    of `size` if there are more; the first piece takes what is over. A null text is empty: one piece, of
    END_ID alone."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(json_file, rank_file, pattern)
        end = np.array([END_ID], dtype="<u4")
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.concatenate((coder(text.as_py() or ""), end)).astype("<u4", copy=False)
                over = len(ids) % size or size
                cuts = [0, *range(over, len(ids) + 1, size)]
                for i in range(len(cuts) - 1):
                    rows.append((doc, i, cuts[i], cuts[i + 1] - cuts[i], zlib.crc32(ids[cuts[i] : cuts[i + 1]])))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.mapInArrow(handed_back(of), PIECES)


def fillings(counts: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """Minimum bin slack over a histogram of lengths: (lengths of a bin, how many bins are filled so).

    Each bin takes the longest piece that is left; subset sums of the others, held as bits of one
    integer, give the fullest bin that it can be part of. Longer pieces are tried first. The filling is
    used as often as the pieces last, which ends some length or makes it too rare for that filling: there
    are at most sum(size / length) different fillings, some 7,700 for 1,024.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    out = []
    while left:
        first = max(left)
        room, mask = size - first, (1 << (size - first + 1)) - 1
        left[first] -= 1
        reach, steps = 1, []
        for length in sorted((x for x in left if x <= room and left[x]), reverse=True):
            copies, part = min(left[length], room // length), 1
            while copies:
                take = min(part, copies)
                steps.append((length, take, reach))
                reach |= (reach << (length * take)) & mask
                copies, part = copies - take, part * 2
            if reach >> room & 1:
                break
        left[first] += 1
        at, use = reach.bit_length() - 1, {first: 1}
        for length, take, before in reversed(steps):
            if not before >> at & 1:
                use[length] = use.get(length, 0) + take
                at -= length * take
        times = min(left[x] // n for x, n in use.items())
        for x, n in use.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        out.append(([x for x in sorted(use, reverse=True) for _ in range(use[x])], times))
    return out


def _slots(plan: list[tuple[list[int], int]]) -> dict[int, dict[str, np.ndarray]]:
    """For each length, runs of ranks: run i starts at rank start[i], its bin b holds use[i] of them from
    offset at[i], and its bins are numbered from bin[i]."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    number = 0
    for lengths, times in plan:
        offset = 0
        for x in dict.fromkeys(lengths):
            n = lengths.count(x)
            runs.setdefault(x, []).append((used.get(x, 0), n, number, offset))
            used[x] = used.get(x, 0) + n * times
            offset += n * x
        number += times
    return {x: dict(zip(("start", "use", "bin", "at"), np.array(r, dtype=np.int64).T)) for x, r in runs.items()}


def pack(pieces: DataFrame, size: int = 1024, bucket_rows: int = 1024, spread: int = 256, most_rows: int = 250_000) -> DataFrame:
    """`pieces` with sequence_id and offset: all pieces of `size` tokens at most in sequences of `size` at
    most, as few as minimum bin slack finds. Pieces are read four times: give a stored table.

    A piece of `size` tokens is a sequence of its own, with a negative number. The others get ranks within
    their length. A length that a third of all pieces share is no single group: ranks are numbered within
    buckets of some `bucket_rows` rows, up to `spread` of them, then as many as keep them at `most_rows`.
    Buckets are stacked by a running sum over their counts.
    """
    whole = pieces.where(F.col("length") == size)
    pieces = pieces.where(F.col("length") < size)
    totals = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `size` rows at most
    slots = pieces.sparkSession.sparkContext.broadcast(_slots(fillings(totals, size)))
    buckets = [(x, max(1, min(spread, n // bucket_rows), -(-n // most_rows))) for x, n in totals.items()]
    buckets = pieces.sparkSession.createDataFrame(buckets, "length long, buckets int")
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.col("buckets")).cast("int")
    columns = pieces.columns
    pieces = pieces.join(F.broadcast(buckets), "length").withColumn("bucket", bucket)  # `size` rows at most
    counts = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    base = counts.select(
        "length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("base")
    )
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = (
        # a row a bucket: some 1,000 lengths, and a row more for each `bucket_rows` or, beyond, `most_rows`
        pieces.withColumn("own", own).join(base, ["length", "bucket"])
        .withColumn("rank", F.col("base") + F.col("own") - 1)
    )

    @F.pandas_udf(T.StructType().add("sequence_id", T.LongType()).add("offset", T.LongType()))
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        number, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
        for x in np.unique(lengths):
            here, s = lengths == x, slots.value[int(x)]
            run = np.searchsorted(s["start"], ranks[here], side="right") - 1
            within = ranks[here] - s["start"][run]
            number[here] = s["bin"][run] + within // s["use"][run]
            offset[here] = s["at"][run] + within % s["use"][run] * x
        return pd.DataFrame({"sequence_id": number, "offset": offset})

    placed = ranked.withColumn("placed", place("length", "rank")).select(*columns, "placed.sequence_id", "placed.offset")
    alone = whole.select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionAll(alone)


def packed_documents(
    docs: DataFrame,
    json_file: str,
    rank_file: str | None = None,
    pattern: str | None = None,
    size: int = 1024,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per piece of `docs`: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts count as empty (one token). Rows that repeat are packed as often as they stand, null ids
    too. An empty table gives an empty table. Other columns aren't read. Vocabulary files must stand at
    the same path on every executor.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return pack(written(token_pieces(docs, json_file, rank_file, pattern, size), "pieces"), size)
