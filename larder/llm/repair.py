"""Token ids in files compressed by Re-Pair, one grammar a shard.

A shard is a run of whole documents. Pairs of neighbouring symbols that are frequent in it become
nonterminals, again and again, until no pair is frequent; what is left are the rules (a pair each), how
many ids each stands for, and the documents' symbols. No rule crosses the end of a document, so a
document, or any stretch of one, is decoded from its own symbols: lengths say where an id lies.

Shards are rows of a Parquet table in ascending order of documents, each a binary value in the format below
beside numbers that say what it holds, so that readers of some documents skip the others' shards. Spark's
committer writes it: a task that is lost and run again leaves nothing behind.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import stored
from larder.llm.packing import _coder

#: Format of a shard, little-endian: the magic, then numbers of terminals (ids below it stand for themselves), rules,
#: symbols and documents as uint32; two symbols a rule, by number of the rule; ids each rule stands for as uint32;
#: symbols of all documents; for each document its number of symbols as uint32. A symbol takes 3 bytes.
MAGIC = b"LRP1"
_HEAD = struct.Struct("<4s4I")
SHARD_SCHEMA = "part long, shard long, start long, n_ids long, n_docs long, first_doc long, last_doc long, doc_ids array<long>, n_symbols long, n_rules long, grammar binary"
_LIMIT = 1 << 24
_LAST = np.uint32(1 << 31)  # marks a document's last symbol while a shard is compressed


def _spelled(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The ids that `symbols` stand for, all of which stand in `text` at `starts`."""
    n = lengths[symbols]
    ends = np.cumsum(n)
    return text[np.repeat(starts[symbols] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


def _hashed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """32 bits of a pair, whose upper ones choose a slot."""
    h = left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA77)
    return (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)


def _taken(places: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of the candidate places (ascending) are replaced, never two neighbours: a place gives way to a
    neighbour of better rank, and of what is then left of a run every other place is taken."""
    apart = np.diff(places) > 1
    good = np.ones(len(places), bool)
    good[1:] &= apart | (rank[1:] <= rank[:-1])
    good[:-1] &= apart | (rank[:-1] <= rank[1:])
    left = np.flatnonzero(good)
    new = np.diff(places[left], prepend=-2) > 1
    run = np.maximum.accumulate(np.where(new, np.arange(len(left)), 0))
    return left[(np.arange(len(left)) - run) % 2 == 0]


def compress(ids: np.ndarray, counts: np.ndarray, least: int = 4, band: float = 8.0) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(terminals, rules, symbols, symbols of each document) of the `ids` of documents, `counts` of them each.

    Rounds go down through bands of frequency: a round takes all pairs within documents that are met at
    least 1 / `band` as often as the round before asked for, the more frequent ones going first where pairs
    overlap, and the last ones ask for `least` until no pair is left that is met so often. Counts are exact:
    hashed counts, which are never lower, only tell beforehand which places can matter, and once a round
    has asked for `least`, only pairs with a new symbol and places passed over can matter in the next.
    """
    terminals = int(ids.max(initial=0)) + 1
    now = ids.astype(np.uint32)
    now[np.cumsum(counts)[counts > 0] - 1] |= _LAST
    rules, n_symbols, asked, look = [np.zeros((0, 2), np.int64)], terminals, 0.0, None
    while len(now) > 1:
        if look is None:
            h = _hashed(now[:-1], now[1:] & ~_LAST)
            slots = (h >> np.uint32(12)).astype(np.int64)
            about = np.bincount(slots, minlength=1 << 20).astype(np.int32)
            asked = max(least, (asked or int(about.max())) / band)
            places = np.flatnonzero((about[slots] >= asked) & (now[:-1] < _LAST))
        else:
            places = look[now[look] < _LAST]
        hot = (now[places].astype(np.int64) << 24) | (now[places + 1] & ~_LAST)
        some = np.sort(hot)
        edges = np.flatnonzero(np.diff(some, prepend=-1))
        times = np.diff(edges, append=len(some))
        chosen = np.flatnonzero(times >= asked)
        if not len(chosen):
            if asked <= least:
                break
            continue
        order = np.argsort(-times[chosen], kind="stable")
        chosen = np.sort(chosen[order[: _LIMIT - n_symbols]])
        pairs = some[edges[chosen]]
        rank_of = np.empty(len(pairs), np.int64)
        rank_of[np.argsort(-times[chosen], kind="stable")] = np.arange(len(pairs))
        if look is None:  # a table of hashes finds the places of chosen pairs; of two pairs in one slot one waits
            shift = np.uint32(32 - min(20, max(12, int(4 * len(pairs)).bit_length())))
            number = np.full(1 << (32 - int(shift)), -1, np.int64)
            own = _hashed((pairs >> 24).astype(np.uint32), (pairs & (_LIMIT - 1)).astype(np.uint32)) >> shift
            number[own] = np.arange(len(pairs))
            waiting = (number[own] != np.arange(len(pairs))).any()
            which = number[h[places] >> shift]
        else:
            which = np.minimum(np.searchsorted(pairs, hot), len(pairs) - 1)
        found = np.flatnonzero((which >= 0) & (pairs[which] == hot))
        at, which = places[found], which[found]
        taken = _taken(at, rank_of[which])
        left = places if look is None and waiting else np.delete(at, taken)
        at, which = at[taken], which[taken]
        used = np.zeros(len(pairs), bool)
        used[which] = True
        if not used.any():  # no symbol is left for a rule
            break
        now[at] = (np.cumsum(used) - 1 + n_symbols).astype(np.uint32)[which] | now[at + 1] & _LAST
        keep = np.ones(len(now), bool)
        keep[at + 1] = False
        if asked <= least:
            moved = np.cumsum(keep) - 1
            near = np.zeros(int(moved[-1]) + 1, bool)
            near[moved[at]] = near[np.maximum(moved[at] - 1, 0)] = near[moved[left[keep[left]]]] = True
            look = np.flatnonzero(near[:-1])
        now = now[keep]
        rules.append(np.stack((pairs >> 24, pairs & (_LIMIT - 1)), axis=1)[used])
        n_symbols += len(rules[-1])
    symbols_of = np.zeros(len(counts), np.int64)
    symbols_of[counts > 0] = np.diff(np.flatnonzero(now >= _LAST), prepend=-1)
    return terminals, np.concatenate(rules), now & ~_LAST, symbols_of


def _packed(symbols: np.ndarray) -> bytes:
    return np.ascontiguousarray(symbols.astype("<u4").reshape(-1, 1).view(np.uint8)[:, :3]).tobytes()


def _unpacked(data: memoryview) -> np.ndarray:
    out = np.zeros((len(data) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(data, np.uint8).reshape(-1, 3)
    return out.view("<u4").ravel().astype(np.int64)


def _rule_text(terminals: int, rules: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, text) for all symbols: terminals first, then each rule's ids. Rules refer to earlier
    ones; those that refer to none of their own run are written at once."""
    n = terminals + len(rules)
    starts, lengths = np.arange(n), np.ones(n, np.int64)
    pieces, size, at = [np.arange(terminals)], terminals, 0
    text = pieces[0]
    newest = np.maximum.accumulate(rules.max(axis=1, initial=-1)) if len(rules) else np.zeros(0, np.int64)
    while at < len(rules):
        end = max(at + 1, int(np.searchsorted(newest, terminals + at)))
        some = rules[at:end]
        lengths[terminals + at : terminals + end] = lengths[some].sum(axis=1)
        made = _spelled(some.ravel(), starts, lengths, text)
        ends = size + np.cumsum(lengths[terminals + at : terminals + end])
        starts[terminals + at : terminals + end] = ends - lengths[terminals + at : terminals + end]
        text, size, at = np.concatenate((text, made)), int(ends[-1]), end
    return starts, lengths, text


def packed_shard(ids: np.ndarray, counts: np.ndarray, **options) -> tuple[bytes, int, int]:
    """(a shard in the format, symbols, rules)."""
    terminals, rules, symbols, per = compress(ids, counts, **options)
    if terminals + len(rules) > _LIMIT:
        raise OverflowError("ids don't fit in 3 bytes")
    _, lengths, _ = _rule_text(terminals, rules)
    parts = [
        _HEAD.pack(MAGIC, terminals, len(rules), len(symbols), len(counts)), _packed(rules.ravel()),
        lengths[terminals:].astype("<u4").tobytes(), _packed(symbols), per.astype("<u4").tobytes(),
    ]
    return b"".join(parts), len(symbols), len(rules)


class Shard:
    """A shard read back. `ids(k)` are those of its k-th document, `ids(k, a, b)` a stretch of them: rules'
    lengths tell which symbols hold it, and only these are spelled out."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        magic, self.terminals, n_rules, n_symbols, n_docs = _HEAD.unpack_from(view)
        at = [_HEAD.size]
        for n in (6 * n_rules, 4 * n_rules, 3 * n_symbols, 4 * n_docs):
            at.append(at[-1] + n)
        if magic != MAGIC or at[-1] != len(view):
            raise ValueError("no shard of this format")
        self.rules = _unpacked(view[at[0] : at[1]]).reshape(-1, 2)
        self.lengths = np.concatenate((np.ones(self.terminals, np.int64), np.frombuffer(view[at[1] : at[2]], "<u4").astype(np.int64)))
        self.symbols = _unpacked(view[at[2] : at[3]])
        self.ends = np.cumsum(np.frombuffer(view[at[3] : at[4]], "<u4").astype(np.int64))

    def all_ids(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, number of ids of each)."""
        starts, lengths, text = _rule_text(self.terminals, self.rules)
        so_far = np.concatenate(([0], np.cumsum(lengths[self.symbols])))
        return _spelled(self.symbols, starts, lengths, text), np.diff(so_far[np.concatenate(([0], self.ends))])

    def ids(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        own = self.symbols[self.ends[k - 1] if k else 0 : self.ends[k]]
        ends = np.cumsum(self.lengths[own])
        start, stop, _ = slice(start, stop).indices(int(ends[-1]) if len(ends) else 0)
        if stop <= start:
            return np.zeros(0, np.int64)
        first, last = np.searchsorted(ends, (start, stop - 1), side="right")
        begins, stack, out = int(ends[first] - self.lengths[own[first]]), own[first : last + 1][::-1].tolist(), []
        while stack:
            symbol = stack.pop()
            if symbol < self.terminals:
                out.append(symbol)
            else:
                stack += self.rules[symbol - self.terminals][::-1].tolist()
        return np.array(out, dtype=np.int64)[start - begins : stop - begins]


def write_shards(docs: DataFrame, json_file: str, rank_file: str | None, pattern: str | None, end_id: int = 0, shard_ids: int = 1 << 20, **options) -> tuple[DataFrame, str]:
    """The ids of every row of `docs` (doc_id long, text string), `end_id` after each, as a table of
    SHARD_SCHEMA, and its path. A null text is empty.

    Documents go in ascending order of doc_id, null ids first, rows of one id as they come. They are dealt
    into ranges of that whole order, so that an id that repeats is no hot spot, and sorted there; a range
    is read as a stream, and a shard ends with the document that brings it to `shard_ids` ids. A task holds
    a shard's ids and one batch of texts.
    """
    order = ["doc_id", "row"]
    ordered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(json_file, rank_file, pattern)
        end = np.array([end_id], dtype=np.uint32)
        part, shard, start = TaskContext.get().partitionId(), 0, 0
        names, held, n = [], [], 0

        def closed() -> pa.RecordBatch:
            nonlocal shard, start, n
            counts = np.array([len(x) for x in held])
            data, n_symbols, n_rules = packed_shard(np.concatenate(held), counts, **options)
            known = [x for x in names if x is not None]
            row = [part, shard, start, n, len(held), min(known, default=None), max(known, default=None), list(names), n_symbols, n_rules, data]
            kinds = [*[pa.int64()] * 7, pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=[c.split()[0] for c in SHARD_SCHEMA.split(", ")])
            shard, start, n = shard + 1, start + n, 0
            names.clear()
            held.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.append(np.concatenate((coder(text.as_py() or ""), end)))
                names.append(doc)
                n += len(held[-1])
                if n >= shard_ids:
                    yield closed()
        if held:
            yield closed()

    return stored(ordered.select("doc_id", "text").mapInArrow(of, SHARD_SCHEMA), "shards")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


def documents_of(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a table of shards, whose ids are decoded.

    start: ids of all documents before it. Shards know how many ids stand before them in their range;
    what stands before a range is summed from the numbers alone, a row for each range."""
    totals = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before, so_far = {}, 0
    for part, n in totals:
        before[part], so_far = so_far, so_far + n

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, counts = Shard(row["grammar"]).all_ids()
                ends = np.cumsum(counts)
                data = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(ends - counts + (row["start"] + before[row["part"]])), pa.array(counts), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    columns = ("part", "start", "doc_ids", "grammar")
    return shards.select(*columns).mapInArrow(of, "doc_id long, start long, n_tokens long, ids_crc32 long")


def ids_of(shards: DataFrame, doc_ids: list[int], start: int = 0, stop: int | None = None) -> DataFrame:
    """(doc_id, ids array<long>): the ids from `start` to before `stop` of some documents. Shards that can't hold one
    aren't read, nor are other documents decoded. A document that repeats comes as often as it stands there."""
    wanted = set(doc_ids)
    near = shards.where(F.coalesce(*(F.when(F.lit(i).between(F.col("first_doc"), F.col("last_doc")), True) for i in sorted(wanted)), F.lit(False))) if wanted else shards.limit(0)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                places = [(k, d) for k, d in enumerate(row["doc_ids"]) if d in wanted]
                shard = Shard(row["grammar"]) if places else None
                found = [shard.ids(k, start, stop) for k, _ in places]
                yield pa.RecordBatch.from_arrays([pa.array([d for _, d in places], pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return near.select("doc_ids", "grammar").mapInArrow(of, "doc_id long, ids array<long>")
