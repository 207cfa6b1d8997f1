"""Word hashes, n-gram join, decontamination, license scan, line dedup against plain Python."""

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larder.llm import decontaminate, license_scan, line_dedup, ngram_join, textops
from larder.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, label string, component string, words string"


def docs_of(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("block", [3, 1 << 20])
def test_word_hashes(monkeypatch, block):
    monkeypatch.setattr(textops, "_BLOCK", block)
    texts = ["Ab c\td", "", None, "ab", "  x", "é É z9", "c", "a" * 5000 + " b", "ab\x0bc"]
    hashes, counts = textops.word_hashes(pa.array(texts), textops.SPACED)
    want = [w for t in texts for w in (t or "").encode().lower().split()]
    assert counts.tolist() == [len((t or "").encode().split()) for t in texts]
    assert len({(h, w) for h, w in zip(hashes.tolist(), want)}) == len(set(want)) == len(set(hashes.tolist()))
    sliced = pa.array(["zz", *texts])[1:]
    assert textops.word_hashes(sliced, textops.SPACED)[0].tolist() == hashes.tolist()


def test_slices_cover_the_batch():
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(["a" * 10, None, "b" * 100, "", "c"])], names=["i", "t"])
    parts = list(textops.slices(batch, 1, 20))
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(5)) and len(parts) > 1


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 3), (9, 8), (5, 1), (8, 7), (20, 21)] + [(100 + i, 101 + i) for i in range(40)] + [(200, i) for i in range(201, 260)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {1: 1, 2: 1, 3: 1, 5: 1, 7: 7, 8: 7, 9: 7, 20: 20, 21: 20} | {i: 100 for i in range(100, 141)} | {i: 200 for i in range(200, 260)}
    assert found == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_components(rows, k=5, percent=75):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    group = {d: d for d in sets}
    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]) and group[a] != group[b]:
            low, high = sorted((group[a], group[b]))
            group = {d: low if g == high else g for d, g in group.items()}
    return {(d, len(sets[d]), group[d]) for d in sets}


@pytest.mark.parametrize("tile_rows, best", [(4096, 8), (7, 1)])
def test_ngram_components_against_all_pairs(spark, tile_rows, best):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(60)]
    base = [[words[i] for i in rng.integers(0, 60, int(n))] for n in rng.integers(8, 80, 12)]
    rows = []
    for i in range(160):
        w = list(base[i % 12])
        for _ in range(int(rng.integers(0, 6))):
            w[int(rng.integers(0, len(w)))] = words[int(rng.integers(0, 60))]
        rows.append((i + 1, " ".join(w[: int(rng.integers(max(5, len(w) - 8), len(w) + 1))])))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "one two"), (504, "ONE  two"), (505, "one two three"), (506, "é É"), (507, "É é")]
    rows += [(600 + i, "the same words over and over again in each of these copies") for i in range(40)]
    found = ngram_join.ngram_components(docs_of(spark, rows), tile_rows=tile_rows, best=best)
    assert {tuple(r) for r in found.collect()} == brute_components(rows)


def test_ngram_components_odd_tables(spark):
    rows = [(1, "a b c d e f", "x"), (None, "a b c d e f", "x"), (2, "a b c d e f", "y"), (None, None, None)]
    found = ngram_join.ngram_components(docs_of(spark, rows, "doc_id long, text string, component_id string"))
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, 2, 1), (2, 2, 1), (None, 2, 1), (None, 0, None)], key=str)
    found = ngram_join.ngram_components(docs_of(spark, [(None, "a b c d e f"), (None, "a b c d e f"), (3, " ")]))
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(None, 2, None), (None, 2, None), (3, 0, 3)], key=str)
    assert ngram_join.ngram_components(docs_of(spark, [])).count() == 0


def test_bitmap_bound_holds():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = np.unique(rng.integers(0, 400, int(rng.integers(1, 300))).astype(np.uint64))
        b = np.unique(rng.integers(0, 400, int(rng.integers(1, 300))).astype(np.uint64))
        maps = [ngram_join._bitmap(x) for x in (a, b)]
        bits = [ngram_join._folded([m], min(map(len, maps))) for m in maps]
        bound = ngram_join.overlap_bounds(np.array([len(a)]), bits[0], np.array([len(b)]), bits[1])[0, 0]
        assert len(np.intersect1d(a, b)) <= bound


def brute_tiling(doc, item, k):
    """Greedy string tiling as published, by comparing all places."""
    marked_d, marked_i, covered = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for a in range(len(item)):
            for p in range(len(doc)):
                n = 0
                while a + n < len(item) and p + n < len(doc) and item[a + n] == doc[p + n] and a + n not in marked_i and p + n not in marked_d:
                    n += 1
                if n > best[0]:
                    best = (n, a, p)
        if best[0] < k:
            return covered / len(item)
        n, a, p = best
        marked_i.update(range(a, a + n))
        marked_d.update(range(p, p + n))
        covered += n


def test_contamination_against_brute_force(spark):
    rng = np.random.default_rng(11)
    words = [f"x{i}" for i in range(25)]
    items = [(i, " ".join(words[j] for j in rng.integers(0, 25, 20))) for i in range(6)] + [(7, "x1 short"), (8, None), (None, "x3 x4 x5"), (9, "..."), (10, "x7")]
    docs = []
    for d in range(60):
        w = [words[j] for j in rng.integers(0, 25, int(rng.integers(0, 60)))]
        if d % 2:
            source = items[d % 6][1].split()
            cut = int(rng.integers(0, 20))
            w += (source[cut:] + source[:cut])[: int(rng.integers(4, 21))]
        docs.append((d, ", ".join(w).upper() if d % 3 else " ".join(w)))
    docs += [(90, None), (91, ""), (92, "X1 short"), (93, "x1, shorter"), (94, "and x3 x4; x5"), (95, "x5 x4 x3")]
    k, threshold = 4, 0.5
    found = {r["doc_id"]: r for r in decontaminate.contamination(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string"), k, threshold).collect()}
    tokens = lambda t: re.findall(r"\w+", (t or "").lower())
    hits = 0
    for d, t in docs:
        share = {i: brute_tiling(tokens(t), tokens(x), min(k, len(tokens(x)))) for i, x in items if x and tokens(x)}
        over = {i: c for i, c in share.items() if c >= threshold}
        assert found[d]["contaminated"] == bool(over) and found[d]["n_items"] == len(over)
        if over:
            hits += 1
            assert found[d]["coverage"] == pytest.approx(max(over.values()))
            best = [i for i, c in over.items() if c == max(over.values())]
            assert found[d]["item_id"] == (min(i for i in best if i is not None) if best != [None] else None)
    assert hits > 10


def test_contamination_of_rows_without_or_with_one_id(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    items = spark.createDataFrame([(1, item), (1, "one two three four five six"), (2, "short item")], "item_id long, text string")
    rows = [(None, item, "x"), (None, "clean words only", "x"), (5, item[:22], "x"), (5, item[22:], "x"), (6, "alpha beta gamma x delta", "x"), (6, "epsilon zeta eta theta", "x"), (7, "a short  ITEM!", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key_a string").withColumn("coverage", F.lit(1)).withColumn("grams", F.lit(2))
    found = decontaminate.contamination(docs, items)
    assert sorted(((r["doc_id"], r["contaminated"], r["item_id"]) for r in found.collect()), key=str) == sorted(
        [(None, True, 1), (None, False, None), (5, True, 1), (5, True, 1), (6, False, None), (6, True, 1), (7, True, 2)], key=str
    )
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "clean words only"), (6, "alpha beta gamma x delta")]


def test_tiling_of_repetitive_texts(spark):
    import time

    for unit, words in ((["a"], 1000), (["a", "b"], 1000), (["a", "a", "b"], 600)):
        doc = np.array([hash(unit[i % len(unit)]) for i in range(20_000)])
        item = doc[:words]
        grams = lambda x: (x[:-3] * 3 + x[1:-2] * 5 + x[2:-1] * 7 + x[3:]).astype(np.int64)
        began = time.time()
        assert decontaminate.tiles(np.arange(len(doc) - 3), grams(doc), grams(item), 4) == [(0, 0, words)]
        assert time.time() - began < 5
    items = spark.createDataFrame([(1, "a " * 1000), (2, "a " * 200)], "item_id long, text string")
    found = decontaminate.contamination(docs_of(spark, [(1, "a " * 20_000), (2, "a " * 500), (3, "a a a")]), items).collect()
    assert {(r["doc_id"], r["contaminated"], r["item_id"], r["coverage"], r["n_items"]) for r in found} == {(1, True, 1, 1.0, 2), (2, True, 2, 1.0, 2), (3, False, None, 0.0, 0)}


def test_tiles_equal_published_tiling():
    rng = np.random.default_rng(31)
    for trial in range(300):
        letters = int(rng.integers(1, 5))
        doc, item = (rng.integers(0, letters, int(rng.integers(0, 60))).tolist() for _ in range(2))
        k = int(rng.integers(1, 5))
        if len(item) < k:
            continue
        grams = lambda x: np.array([hash(tuple(x[i : i + k])) for i in range(len(x) - k + 1)], dtype=np.int64)
        found = decontaminate.tiles(np.arange(max(0, len(doc) - k + 1)), grams(doc), grams(item), k)
        assert sum(x[2] for x in found) / len(item) == pytest.approx(brute_tiling(doc, item, k)), trial

def test_reordered_passages_are_caught(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
    w = item.split()
    doc = " ".join(["intro", *w[8:], "between these", *w[:8], "end"])
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = docs_of(spark, [(5, 0, doc), (6, 0, "nothing of it here at all")], "key_a long, key_b long, text string")
    found = decontaminate.overlaps(docs, items).collect()
    assert [(r["key_a"], r["coverage"], len(r["tiles"])) for r in found] == [(5, 1.0, 2)]
    assert decontaminate.contamination(docs_of(spark, []), items).count() == 0
    assert not decontaminate.contamination(docs_of(spark, [(5, doc)]), items.limit(0)).where("contaminated").count()


def brute_phrases(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    starts, labels = [], set()
    for phrase, label in license_scan.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        starts += at
        if at:
            labels.add(label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


LICENSES = [
    "Released under the MIT License. MIT license, mit-license; MIT\nLicense",
    "GNU General Public License GNU General Public License apache license",
    "Licensed under CC BY-NC 4.0.",
    "permission is hereby granted free of charge to any person who is obtaining a copy of this software and associated documentation files the software to deal in software without restriction",
    "commitlicense mit éLicense gnu general license", "", None, "mit", "license mit", "cc by cc by cc by " * 50,
]


def test_license_digest_against_plain_search(spark, sf_dir):
    rows = list(enumerate(LICENSES)) + [(10_000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = {r["doc_id"]: r for r in license_scan.license_digest(docs_of(spark, rows)).collect()}
    assert len(found) == len(rows)
    for d, t in rows:
        r = found[d]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_phrases(t), t
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}
        assert 0 <= r["score"] <= 1
    assert "mit-notice" in found[3]["labels"] and found[3]["n_base"] == 0 and found[3]["score"] < 1
    assert "cc-by-nc-4.0" in found[2]["labels"]
    assert license_scan.license_digest(docs_of(spark, [])).count() == 0
    odd = license_scan.license_digest(docs_of(spark, [(None, "mit license", "x"), (1, "mit license", None)], "doc_id long, text string, label string"))
    assert {(r["doc_id"], r["n_base"]) for r in odd.collect()} == {(None, 1), (1, 1)}
    rows = [(1, "gnu general public x"), (1, "x general public license"), (2, "mit license"), (2, "apache license"), (2, "mit license"), (None, "cc by"), (None, "x")]
    shared = license_scan.license_digest(docs_of(spark, [(*r, 1) for r in rows], "doc_id long, text string, key_a int"))
    assert sorted(((r["doc_id"], r["n_base"], r["base_labels"]) for r in shared.collect()), key=str) == sorted(
        [(1, 0, ""), (1, 0, ""), (2, 1, "mit"), (2, 1, "apache"), (2, 1, "mit"), (None, 1, "cc-by"), (None, 0, "")], key=str
    )


def brute_coverage(text, notice, k, slack):
    """The most words of a notice that a chain of hits covers: hits of k words, both places rising,
    diagonals of neighbours `slack` apart at most; all chains are tried, one hit at a time."""
    t, n = license_scan.template_words(text), license_scan.template_words(notice)
    hits = sorted((p, a) for a in range(len(n) - k + 1) for p in range(len(t) - k + 1) if t[p : p + k] == n[a : a + k])
    best = {}
    for p, a in hits:
        best[p, a] = max([k] + [w + min(k, a - b, p - q) for (q, b), w in best.items() if q < p and b < a and abs(p - q - (a - b)) <= slack])
    return max(best.values(), default=0) / len(n)


def test_notices_against_all_chains(spark):
    rng = np.random.default_rng(8)
    notices = license_scan.NOTICES[:9]
    rows = []
    for i in range(80):
        words = license_scan.template_words(notices[i % 9][0])
        for _ in range(int(rng.integers(0, 7))):
            at = int(rng.integers(0, len(words)))
            words[at : at + int(rng.integers(0, 3))] = ["w"] * int(rng.integers(0, 3))
        rows.append((i, " ".join(["before"] * int(rng.integers(0, 5)) + words + ["after"])))
    _, spans = license_scan.scan(docs_of(spark, rows), phrases=[], notices=notices)
    texts = dict(rows)
    keys = {tuple(r): i for i, t in rows for r in docs_of(spark, [(i, t)]).select(*license_scan.row_key("doc_id", "text")).collect()}
    found = {(keys[r["key_a"], r["key_b"]], r["label"]): r["coverage"] for r in spans.collect()}
    want = {}
    for i, t in texts.items():
        for notice, label in notices:
            size = len(license_scan.template_words(notice))
            share = brute_coverage(t, notice, 2, max(3, int(0.2 * size + 1e-9)))
            if share >= 0.8:
                want[i, label] = pytest.approx(share)
    assert found == want and len(want) > 30


def test_rows_that_share_an_id_link_each_for_itself(spark, sf_dir):
    import corpus_pipeline

    w = [f"w{i}" for i in range(400)]
    long, short, other, tie = " ".join(w[:60]), " ".join(w[100:140]), " ".join(w[200:240]), " ".join(w[300:340])
    rows = [(1, short), (1, long), (1, None), (2, short + " more"), (3, long + " more"), (4, other), (4, other), (6, tie), (6, other), (None, tie + " x"), (None, tie + " x"), (7, ""), (7, "")]
    for seed in range(2):
        docs = spark.createDataFrame(sorted(((*r, 1, 2.0) for r in rows), key=lambda r: hash((seed, r))), "doc_id long, text string, row_a int, component double").repartition(seed + 1)
        found = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(docs).collect()), key=str)
        want = [(1, 36, 1), (1, 56, 1), (1, 0, 1), (2, 37, 1), (3, 57, 1), (4, 36, 4), (4, 36, 4), (6, 36, 6), (6, 36, 4), (None, 37, 6), (None, 37, 6), (7, 0, 7), (7, 0, 7)]
        assert found == sorted(want, key=str)
        kept = corpus_pipeline.dedup_documents(spark, docs, sf_dir)
        assert kept.columns == docs.columns
        want = [(1, short), (1, long), (1, None), (4, other), (6, tie), (7, ""), (7, "")]
        assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_pipeline_drops_what_is_white_space_without_its_boilerplate(spark, sf_dir):
    import corpus_pipeline

    lines = ["Subscribe", "Subscribe\r", "Subscribe\t", " Subscribe", "Subscribe \r"]
    rows = [(i, f"{x}\nown {i}", f"s{i}") for i, x in enumerate(lines)]
    rows += [(10, "Subscribe\n\n\nSubscribe\r", "s1"), (11, "Subscribe\n\t\n\u3000", "s2"), (12, "\n\n", "s1"), (13, None, "s1"), (14, "Subscribe\n\nx\r", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text").cast("long"))
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.dedup_lines(spark, docs, sf_dir).collect()}
    assert kept == {0: "Subscribe\nown 0", **{i: f"own {i}" for i in range(1, 5)}, 12: "\n\n", 13: None, 14: "\nx\r"}


def changed(notice, at, by=("other",)):
    w = license_scan.template_words(notice)
    for i in sorted(at, reverse=True):
        w[i : i + 1] = by
    return " ".join(["before", *w, "after"])


def test_license_scan_takes_changed_and_inserted_words(spark):
    notice = {label: n for n, label in license_scan.NOTICES}
    mit, bsd = notice["mit-notice"], notice["bsd-notice"]
    w = license_scan.template_words(mit)
    rows = [
        (1, "Licensed under the Apache Licence, Version 2.0", "apache-2.0", 7 / 8),
        (2, changed(mit, [5, 12, 20]), "mit-notice", 26 / 29),
        (3, changed(bsd, [4, 10, 16]), "bsd-notice", 18 / 21),
        (4, changed(mit, [4, 9, 14, 19, 24]), "mit-notice", 24 / 29),
        (5, " ".join(w[:10] + w[15:]), "mit-notice", 24 / 29),  # five words lost at once
        (6, " ".join(x for i in range(0, 29, 3) for x in [*w[i : i + 3], "put", "in"][: 5 if i < 24 else 3]), "mit-notice", 1.0),
        (7, " ".join(["of the"] * 200 + w[:10] + ["of the"] * 200 + w[10:]), None, 0.0),  # halves far apart
        (8, changed(mit, [3, 7, 11, 15, 19, 23]), None, 0.0),
        (9, "all rights reserved " * 3_000, "all-rights-reserved", 1.0),
    ]
    found = {r["doc_id"]: r for r in license_scan.license_digest(docs_of(spark, [r[:2] for r in rows])).collect()}
    for i, _, label, score in rows:
        assert (label in found[i]["labels"].split(",")) if label else not found[i]["labels"], i
        assert found[i]["score"] == pytest.approx(score), i


def test_line_dedup_against_plain_counts(spark):
    rng = np.random.default_rng(2)
    lines = [f"line {i}" for i in range(30)] + ["", "  "]
    rows = []
    for d in range(120):
        text = "\n".join(lines[int(j)] + (" " if d % 5 == 0 else "") for j in rng.zipf(1.6, int(rng.integers(1, 12))) % 32)
        rows.append((d, text, f"s{d % 9}" if d % 7 else None))
    rows += [(200, None, "s1"), (201, "", "s1"), (202, "only here", "s2")]
    for min_sites in (3, 5, 9):
        sites, first = {}, {}
        for d, t, s in rows:
            for p, x in enumerate((t or "").split("\n")):
                if t is not None and x.strip(" "):
                    sites.setdefault(x.strip(" "), set()).add(s)
                    first[x.strip(" ")] = min(first.get(x.strip(" "), (d, p)), (d, p))
        want = set()
        for d, t, s in rows:
            if t is None:
                want.add((d, None, 0, 0))
                continue
            all_ = t.split("\n")
            kept = [x for p, x in enumerate(all_) if not x.strip(" ") or len(sites[x.strip(" ")]) < min_sites or first[x.strip(" ")] == (d, p)]
            want.add((d, "\n".join(kept), len(all_), len(all_) - len(kept)))
        found = line_dedup.remove_boilerplate(docs_of(spark, rows, "doc_id long, text string, source string"), min_sites)
        assert {tuple(r) for r in found.collect()} == want


def test_line_dedup_odd_tables(spark):
    schema = "doc_id long, text string, source string, gone string, hash string"
    rows = [(i, "shared\nown " + str(i), f"s{i}", "g", "h") for i in range(8)] + [(None, "shared", "s1", None, None)]
    found = {(r["doc_id"], r["text"]) for r in line_dedup.remove_boilerplate(docs_of(spark, rows, schema)).collect()}
    assert (0, "shared\nown 0") in found and (5, "own 5") in found and (None, "") in found
    # rows that share an id but not a text; a row without one; rows alike in both
    rows = [(i, f"shared line\nown {i}", f"s{i}", "g", "h") for i in range(5)]
    rows += [(100, "keep me\nkeep too", "s1", "g", "h"), (100, "shared line\nmine", "s2", "g", "h"), (None, "mine too\nshared line", "s1", "g", "h"), (100, "shared line\nmine", "s2", "g", "h")]
    found = sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in line_dedup.remove_boilerplate(docs_of(spark, rows, schema)).collect()), key=str)
    want = [(0, "shared line\nown 0", 0), *((i, f"own {i}", 1) for i in range(1, 5)), (100, "keep me\nkeep too", 0), (100, "mine", 1), (100, "mine", 1), (None, "mine too", 1)]
    assert found == sorted(want, key=str)
    assert line_dedup.remove_boilerplate(docs_of(spark, [], schema)).count() == 0


def test_sketches_are_exact_near_the_threshold(spark):
    lines = spark.range(0, 300).select((F.col("id") % 3).alias("line_a"), F.lit(0).alias("line_b"), F.col("id").alias("place"), (F.col("id") % (97 + F.col("id") % 3)).cast("string").alias("site"))
    want = {r["line_a"] for r in lines.groupBy("line_a").agg(F.count_distinct("site").alias("n")).where("n >= 100").collect()}
    assert {r["line_a"] for r in line_dedup.boilerplate(lines, 100).collect()} == want
