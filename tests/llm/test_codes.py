"""Vector codes, compressed shards and hard negatives against plain loops."""

import hashlib
import json
import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larder.llm import hard_negatives, queries, repair, vector_codes

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<float>, label int, code string, v int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "own", 1) for r in rows], VECTORS)


def plain_codes(rows, parts, entries, rounds, scale=256):
    kept = [(i, [int(np.floor(np.float64(np.float32(x)) * scale)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [list(x) for x in zip(*(cut(v) for _, v, _ in sorted(kept, key=lambda r: (r[0], r[1]))[:entries]))]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        found = [[near(p, x)[1] for p, x in enumerate(cut(v))] for _, v, _ in kept]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v)[p] for (_, v, _), f in zip(kept, found) if f[p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    out = []
    for i, v, label in kept:
        best = [near(p, x) for p, x in enumerate(cut(v))]
        out.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), label))
    sums = Counter()
    for _, _, d, label in out:
        sums[label] += d
    digest = hashlib.sha256(",".join(str(x) for b in zip(books) for p in b for c in p for x in c).encode()).hexdigest()
    return sorted((i, code, d, sums[label], digest) for i, code, d, label in out)


def test_codes_against_a_loop(spark):
    rng = random.Random(4)
    # few values, so that entries tie and repeat
    rows = [(i, [rng.choice([-0.5, -0.001, 0.0, 0.25, 0.7]) for _ in range(8)], rng.choice([0, 1, None])) for i in range(300, 0, -1)]
    rows += [(7, rows[0][1], 1), (7, rows[1][1], 2), (500, None, 0), (501, [0.1] * 7 + [None], 0), (502, [NAN] + [0.1] * 7, 1), (503, [INF] + [0.1] * 7, 1)]
    found = vector_codes.code_digest(vectors(spark, rows).repartition(5), parts=4, entries=9, rounds=2)
    assert sorted(map(tuple, found.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())) == plain_codes(rows, 4, 9, 2)


def test_codes_of_odd_tables(spark):
    assert vector_codes.code_digest(vectors(spark, []), parts=4).count() == 0
    assert vector_codes.code_digest(vectors(spark, [(1, None, 1)]), parts=4).count() == 0
    rows = [(1, [0.5] * 4, None), (2, [0.5] * 3, 1), (3, [], 1), (None, [0.25] * 4, None), (1, [0.5] * 4, None)]
    found = {(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in vector_codes.code_digest(vectors(spark, rows), parts=4).collect()}
    # Both entries are 128 and the first takes all: it becomes 106, then 64, and the second keeps 128. A null
    # id starts no entry; other lengths have no code.
    assert found == {(1, "01010101", 0, 0), (2, None, None, None), (3, None, None, None), (None, "00000000", 0, 0)}
    books = vector_codes.fit(vectors(spark, rows), parts=4, rounds=0)
    back = vector_codes.decode(vector_codes.encode(vectors(spark, rows), books), books).cache()
    assert [r["vector"] for r in back.where("vec_id = 1").collect()] == [[0.5] * 4] * 2 and back.where("vec_id = 3").first()["vector"] is None


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 6), st.sampled_from([3, 200, 10**6, 2**28]))
def test_nearest_entries_are_exact(seed, width, size):
    """Large components, where single precision can't tell entries apart, and ties."""
    rng = np.random.default_rng(seed)
    entries = rng.integers(-size, size, (40, width))
    entries[rng.integers(0, 40, 8)] = entries[3]
    part = np.concatenate((rng.integers(-size, size, (30, width)), entries[:5], (entries[5:10] + entries[10:15]) // 2))
    index, d = vector_codes.nearest(part, entries)
    for x, i, e in zip(part.tolist(), index, d):
        assert (e, i) == min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(entries.tolist()))


def test_components_out_of_range():
    with pytest.raises(OverflowError):
        vector_codes.nearest(np.array([[2**40]]), np.array([[-(2**40)]]))


@settings(max_examples=120, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), min_size=1, max_size=60), min_size=1, max_size=12), st.sampled_from([2, 4]), st.sampled_from([1.5, 8.0]))
def test_grammars_give_back_their_ids(docs, least, band):
    counts, flat = np.array([len(d) for d in docs]), np.concatenate([np.array(d) for d in docs])
    data, n_symbols, n_rules = repair.packed_shard(flat, counts, least=least, band=band)
    shard = repair.Shard(data)
    ids, back = shard.all_ids()
    assert ids.tolist() == flat.tolist() and back.tolist() == counts.tolist()
    assert n_symbols + 2 * n_rules <= len(flat) + 2 * n_rules and len(shard.symbols) == n_symbols
    for k, d in enumerate(docs):
        for a, b in ((0, None), (1, 3), (len(d) - 1, len(d)), (5, 2), (-2, None)):
            assert shard.ids(k, a, b).tolist() == d[a:b]
    # no pair within a document is left that is met `least` times
    ends = set(shard.ends.tolist())
    symbols = shard.symbols.tolist()
    left = Counter((symbols[i], symbols[i + 1]) for i in range(len(symbols) - 1) if i + 1 not in ends)
    # overlapping ones, as in a run of one symbol, count once for every two
    assert all(n < least or a == b and n < 2 * least for (a, b), n in left.items())


def test_repeated_texts_shrink():
    flat = np.tile(np.arange(50), 400)
    data, n_symbols, n_rules = repair.packed_shard(np.append(flat, 0), np.array([len(flat) + 1]))
    assert n_symbols + n_rules < 300 and repair.Shard(data).all_ids()[0][:-1].tolist() == flat.tolist()
    with pytest.raises(ValueError):
        repair.Shard(b"XXXX" + data[4:])


@pytest.fixture(scope="module")
def encoder():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def plain_documents(encoder, rows):
    start, out = 0, []
    for doc, text in rows:
        ids = [*encoder.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_shards_of_documents_equal_the_tokenizer(spark, sf_dir, encoder):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
    found = queries.QUERIES["op12_repair_shards"](spark, sf_dir)
    assert sorted(map(tuple, found.select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == plain_documents(encoder, rows)


def test_shards_of_odd_documents(spark, encoder):
    long = "many words of one kind " * 30_000
    rows = [(i, f"text {i % 3} ! <|endoftext|> é\n\n") for i in range(40, 0, -1)] + [(41, None), (42, ""), (43, long), (44, "!" * 500)]
    schema = "doc_id long, text string, part long, hash string, row int"
    table = lambda some: spark.createDataFrame([(d, t, 1, "x", 2) for d, t in some], schema)
    files = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    shards, path = repair.write_shards(table(rows).repartition(7), *files, shard_ids=100)
    assert shards.count() > 3
    want = plain_documents(encoder, sorted(rows))
    assert sorted(map(tuple, repair.documents_of(repair.read_shards(spark, path)).collect())) == want
    some = {r["doc_id"]: r["ids"] for r in repair.ids_of(shards, [3, 41, 43, 99], 1, 5).collect()}
    ids = {d: [*encoder.encode(t or "", add_special_tokens=False).ids, 0] for d, t in rows}
    assert some == {d: ids[d][1:5] for d in (3, 41, 43)}
    assert repair.ids_of(shards, []).count() == 0
    # rows that repeat, share an id or have none stay, nulls first
    odd = [(None, "b"), (5, "x y"), (5, "x y"), (5, "z"), (1, "a")]
    found = sorted(repair.documents_of(repair.write_shards(table(odd), *files)[0]).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == [None, 1, 5, 5, 5] and [r["start"] for r in found] == [0, 2, 4, *np.cumsum([r["n_tokens"] for r in found])[2:4]]
    assert repair.documents_of(repair.write_shards(table([]), *files)[0]).count() == 0


def plain_negatives(rows, anchor, positives=5, negatives=3, low=50, high=95):
    good = [(i, v, label) for i, v, label in rows if i is not None and v and label is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for k, (i, v, label) in enumerate(good):
        if not anchor(i):
            continue
        score = lambda w: sum(a * b for a, b in zip(v, w))
        others = sorted((-score(w), j) for n, (j, w, m) in enumerate(good) if n != k and m == label)[:positives]
        for p, j in others:
            near = sorted((-score(w), n) for n, w, m in good if m != label and low * -p <= 100 * score(w) <= high * -p)[:negatives]
            out += [(i, j, r, n, -p, -s) for r, (s, n) in enumerate(near, 1)]
    return sorted(out)


NEGATIVES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("options", [{}, {"pivots": 3, "group_anchors": 4, "slice_rows": 20}, {"pivots": 12, "least_groups": 30, "slice_rows": 7}])
def test_hard_negatives_against_a_loop(spark, options):
    rng = random.Random(9)
    centres = [[rng.randint(-40, 40) for _ in range(6)] for _ in range(5)]
    rows = [(i, [float(c + rng.randint(-9, 9)) for c in rng.choice(centres)], rng.choice("abc")) for i in range(260)]
    rows += [(i, [float(x) for x in centres[0]], "a" if i % 2 else "b") for i in range(300, 420)]  # a third are copies
    rows += [(10, rows[3][1], "b"), (20, rows[20][1], rows[20][2])]  # a shared id, a row that repeats
    odd = [(430, None, "a"), (440, [1.0] * 6, None), (450, [NAN] * 6, "a"), (460, [1.0, None] * 3, "b"), (None, [1.0] * 6, "a"), (470, [INF] * 6, "c"), (480, [], "a")]
    schema = "vec_id long, vector array<double>, label string, row int, cell string, score long"
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows + odd], schema).repartition(4)
    found = hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, **options)
    assert sorted(map(tuple, found.select(NEGATIVES).collect())) == plain_negatives(rows, lambda i: i % 10 == 0)


def test_hard_negatives_of_small_tables(spark):
    schema = "vec_id long, vector array<double>, label int"
    find = lambda rows, **o: [tuple(r) for r in hard_negatives.hard_negatives(spark.createDataFrame(rows, schema), F.col("vec_id") == 0, **o).select(NEGATIVES).collect()]
    assert find([]) == [] and find([(1, [1.0], 0)]) == [] and find([(0, [1.0], 0)]) == []
    assert find([(0, [0.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [3.0, 1.0], 1)]) == [(0, 1, 1, 2, 0.0, 0.0)]
    assert find([(0, [2.0], 0), (1, [-1.0], 0), (2, [-1.0], 1)]) == []  # below zero the range is empty
    assert find([(0, [10.0], 0), (1, [10.0], 0), (2, [9.5], 1), (3, [5.0], 1), (4, [9.6], 1), (5, [4.9], 1)]) == [(0, 1, 1, 2, 100.0, 95.0), (0, 1, 2, 3, 100.0, 50.0)]


def test_cell_bounds_hold():
    rng = np.random.default_rng(5)
    for _ in range(30):
        points, pivots, asks = (rng.normal(0, 3, (n, 5)) for n in (200, 8, 20))
        d = hard_negatives._distances(points, pivots)
        cell = d.argmin(axis=1)
        own = d[np.arange(200), cell]
        low, high = (np.array([f(own[cell == c]) if (cell == c).any() else 0.0 for c in range(8)]) for f in (np.min, np.max))
        least, most = hard_negatives.cell_bounds(hard_negatives._distances(asks, pivots), hard_negatives._distances(pivots, pivots), low, high)
        true = hard_negatives._distances(asks, points)
        assert (least[:, cell] <= true).all() and (true <= most[:, cell]).all()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for file in os.listdir(sf_dir):
        db.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{file}'")
    cursor = db.execute(queries.SQL[name])
    columns = [c[0] for c in cursor.description]
    whole = lambda rows: sorted(map(str, map(tuple, rows)))
    assert whole(queries.QUERIES[name](spark, sf_dir).select(columns).collect()) == whole(cursor.fetchall())


def test_cells_far_away_are_not_copied(spark):
    """Two far clusters: anchors of one never see candidates of the other."""
    rows = [(i, [100.0 + i % 5, 0.0] if i % 2 else [0.0, 100.0 + i % 5], i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>, label int").select(F.col("vec_id").alias("id"), F.col("vector").alias("v"), "label", F.col("vec_id").alias("row"))
    cells = hard_negatives._Cells(df, 2, 110.0**2)
    candidates = cells.assigned(df)
    cells.measure(candidates)
    far = hard_negatives._distances(hard_negatives._lifted(np.array([[104.0, 0.0]]), cells.longest, True), cells.pivots)
    least, most = hard_negatives.cell_bounds(far, cells.apart, cells.low, cells.high)
    assert len(cells.pivots) == 2 and json.dumps(sorted(cells.count.tolist())) in ("[100, 100]", "[99, 101]") and least.max() > most.min()
