"""Language, quality, tokens, packing, vectors and WARC records against references of their own."""

import gzip
import math
import time
import zlib
from html.parser import HTMLParser
from urllib.parse import urljoin

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larder.llm import embedding_dedup, language, packing, quality, token_count, warc


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_language_on_held_out(spark, documents):
    found = language.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").toPandas()
    held = found[found["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.97
    assert found["score"].between(0, 1).all()
    crc = found["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)
    assert (crc == found["held_out"]).all()


def test_language_mixture_and_odd_rows(spark, documents):
    model = language.fit(documents)
    names = model.names
    texts = {r["lang"]: r["text"] for r in documents.where("n_chars > 2000").collect()}
    a, b = sorted(texts)[:2]
    rows = [(1, texts[a][:1500] + "\n" + texts[b][:1500], "x"), (2, None, None), (3, "", ""), (4, "123 !!", None), (5, texts[a], "lang"), (6, "é", None)]
    found = {r["doc_id"]: r for r in language.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()}
    assert found[1]["languages"] == 2 and found[1]["lang_pred"] in (a, b) and 0.4 < found[1]["score"] < 0.6
    assert [found[i]["lang_pred"] for i in (2, 3, 4)] == ["und"] * 3 and found[2]["score"] == 0
    assert found[5]["lang_pred"] == a and found[5]["score"] > 0.95 and found[6]["lang_pred"] in names
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.identify(empty).count() == 0
    assert language.identify(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).first()["lang_pred"] == "und"


def _six_languages():
    rng = np.random.default_rng(3)
    letters = [chr(0x61 + i) for i in range(24)]
    own = [letters[4 * i : 4 * i + 4] for i in range(6)]
    return {f"l{i}": " ".join("".join(rng.choice(x, 5)) for _ in range(300)) for i, x in enumerate(own)}


def test_texts_in_more_than_four_languages():
    texts = _six_languages()
    grams = [language._grams([t])[0] for t in texts.values()]
    p = np.stack([np.bincount(g, minlength=language.BUCKETS) + 0.5 for g in grams], axis=1)
    p /= p.sum(axis=0)
    n = np.bincount(np.concatenate(grams[:5]), minlength=language.BUCKETS).astype(float)
    some = np.flatnonzero(n)
    w, _ = language.infer(p[some], n[some], 2.0)
    assert (w > 0).tolist() == [True] * 5 + [False] and np.allclose(w[:5], 0.2, atol=0.02)


def test_language_sets_against_all_subsets():
    """The set that steps find has the best penalised likelihood of all 63 sets of six languages."""
    from itertools import combinations

    rng = np.random.default_rng(21)
    base = rng.dirichlet(np.full(400, 0.3))
    for trial in range(25):
        # languages that share much of their letters
        p = np.stack([0.6 * base + 0.4 * rng.dirichlet(np.full(400, 0.1)) for _ in range(6)], axis=1) + 1e-6
        p /= p.sum(axis=0)
        members = rng.permutation(6)[: 1 + trial % 6]
        n = rng.multinomial(int(rng.integers(50, 4000)), p[:, members] @ rng.dirichlet(np.full(len(members), 3.0))).astype(float)
        some = np.flatnonzero(n)
        cost = 2.0 * np.log(n.sum() + 1)
        shares, likelihood = language.infer(p[some], n[some], 2.0)
        found = likelihood - cost * ((shares > 0).sum() - 1)
        best = max(language.proportions(p[some][:, list(s)], n[some], 2000, 1e-8)[1] - cost * (k - 1) for k in range(1, 7) for s in combinations(range(6), k))
        assert found == pytest.approx(best, abs=0.05), trial
        assert shares.sum() == pytest.approx(1)


def test_six_languages_give_six_shares(spark):
    texts = _six_languages()
    rows = [(10 * i + j, t, lang) for i, (lang, t) in enumerate(texts.items()) for j in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    mixed = spark.createDataFrame([(1, "\n".join(t[:900] for t in texts.values()), "c", 0.5)], "score long, text string, shares string, gain double")
    found = language.predict(mixed.select("text"), language.fit(docs)).first()
    assert found["languages"] == 6 and {x["lang"] for x in found["shares"]} == set(texts)
    assert all(x["share"] == pytest.approx(1 / 6, abs=0.03) for x in found["shares"]) and found["score"] == found["shares"][0]["share"]
    clash = spark.createDataFrame([(1, texts["l0"], "l0", 7, "x")], "doc_id long, text string, lang string, score int, shares string")
    assert language.identify(clash.unionByName(docs, allowMissingColumns=True)).count() == 61


def test_pipeline_keeps_texts_in_three_equal_languages(spark, sf_dir):
    import corpus_pipeline

    texts = _six_languages()
    rows = [(10 * i + j, t, lang) for i, (lang, t) in enumerate(texts.items()) for j in range(10)]
    mixed = "\n".join(t[:900] for t in list(texts.values())[:3])
    docs = spark.createDataFrame([*rows, (900, mixed, None), (901, "123 !!", None), (902, None, None)], "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, sf_dir).collect()}
    assert kept == {r[0] for r in rows} | {900}


def test_proportions_climb_and_sum_to_one():
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.ones(200), 3).T
    n = rng.multinomial(5000, p @ [0.7, 0.3, 0.0]).astype(float)
    w, likelihood = language.proportions(p, n, 200, 1e-6)
    assert w.sum() == pytest.approx(1) and w[0] == pytest.approx(0.7, abs=0.05) and w[2] < 0.05
    assert likelihood >= float(n @ np.log(p @ np.array([0.7, 0.3, 0.0]) + 1e-300)) - 0.5
    chosen, _ = language.infer(p, n, 2.0)
    assert (chosen > 0).sum() == 2


def test_quality_on_held_out(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = quality.score_documents(documents, labels)
    held = found.where("held_out").join(labels, "doc_id").toPandas()
    assert (held["predicted"] == held["quality"]).mean() > 0.95
    assert found.count() == documents.count()
    # labels of held-out rows have no part in it
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.score_documents(documents, turned).orderBy("doc_id").limit(50).collect() == found.orderBy("doc_id").limit(50).collect()


def test_quality_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "Some words here.", "c"), (None, "x", None)], "doc_id long, text string, score string")
    labels = "doc_id long, quality int, toxic int"
    for rows in ([], [(1, 1, 0)], [(1, None, 0)], [(1, 1, 0), (2, 0, 0), (3, 1, 1), (3, 1, 1), (None, 0, 0)]):
        found = quality.score_documents(docs, spark.createDataFrame(rows, labels)).collect()
        assert len(found) == 4 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    assert quality.score_documents(docs.limit(0), spark.createDataFrame([], labels)).count() == 0


def test_the_sample_is_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"some text {i}") for i in range(300)] + [(i, "b c") for i in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(-500, 40)], "doc_id long, label int")
    seen = []
    monkeypatch.setattr(quality, "train", lambda x, y, **_: seen.append((len(x), len(y))))
    quality.fit(docs, labels, max_rows=10)
    quality.fit(docs, labels, max_rows=1000)
    # labels without a document take no place; a document that repeats counts as often, within the bound
    assert seen == [(10, 10), (338, 338)]


def test_scores_are_sums_of_looked_up_bins():
    rng = np.random.default_rng(5)
    x = rng.random((500, len(quality.FEATURES))).round(2)
    model = quality.train(x, (x[:, 2] + x[:, 3] > 1).astype(float), rounds=8, pair_rounds=3)
    for row, score in zip(x[:100], model.score(x[:100])):
        z = model.intercept
        for value, edges, table in zip(row, model.edges, model.tables):
            z += table[sum(value >= e for e in edges)]
        for i, j, table in model.pairs:
            z += table[sum(row[i] >= e for e in model.coarse[i]), sum(row[j] >= e for e in model.coarse[j])]
        assert score == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-9)


def test_trees_take_the_best_cut():
    rng = np.random.default_rng(6)
    for _ in range(50):
        g, h = rng.normal(size=7), rng.random(7) + 0.1
        steps = quality._tree(g, h, 1.0, depth=1)
        gain = lambda s: g[s].sum() ** 2 / (h[s].sum() + 1.0)
        cuts = [gain(slice(0, c)) + gain(slice(c, None)) for c in range(1, 7)]
        whole = gain(slice(None))
        assert (g * steps).sum() == pytest.approx(max(max(cuts), whole), rel=1e-6)


def test_pairs_are_learned():
    rng = np.random.default_rng(4)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.train(x[:3000], y[:3000])
    assert (0, 1) in [tuple(sorted(p[:2])) for p in model.pairs]
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9


def test_token_counts_equal_the_tokenizer(spark, documents):
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram
    from tokenizers.pre_tokenizers import Metaspace

    vocabulary = token_count.vocabulary(P.path("piece_bpe_32k.model"))
    exact = Tokenizer(Unigram(vocabulary, 0, byte_fallback=True))
    exact.pre_tokenizer = Metaspace()
    odd = ["", " ", "  a  b ", "▁x▁▁y", "tab\tnew\nline", "日本語 テスト 𝒳𝒴", "<s> </s> <0x41> <unk>", "a" * 3000, "né́e ñandú", "\x00\x01"]
    rows = [(i, t) for i, t in enumerate(odd)] + [(1000 + r["doc_id"], r["text"]) for r in documents.limit(60).collect()] + [(9999, None)]
    found = {r["doc_id"]: r["n_tokens"] for r in token_count.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), P.path("piece_bpe_32k.model")).collect()}
    assert found == {i: len(exact.encode(t or "", add_special_tokens=False).ids) for i, t in rows}
    assert token_count.token_counts(spark.createDataFrame([], "doc_id long, text string"), P.path("piece_bpe_32k.model")).count() == 0


def test_token_counts_equal_a_trained_unigram_tokenizer(spark, documents, tmp_path):
    from sentencepiece import SentencePieceProcessor, SentencePieceTrainer

    texts = [r["text"] for r in documents.where("text <> ''").orderBy("doc_id").limit(150).collect()]
    SentencePieceTrainer.train(
        sentence_iterator=iter([x for t in texts for x in t.split("\n")]), model_prefix=str(tmp_path / "unigram"), model_type="unigram", vocab_size=1200,
        hard_vocab_limit=False, byte_fallback=True, normalization_rule_name="identity", remove_extra_whitespaces=False, num_threads=1, minloglevel=2,
    )
    model = str(tmp_path / "unigram.model")
    exact = SentencePieceProcessor(model_file=model)
    rows = list(enumerate([*texts, "日本語 テスト 𝒳𝒴", "né́e ñandú", "two  spaces", ""]))
    found = {r["doc_id"]: r["n_tokens"] for r in token_count.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert found == {i: len(exact.encode(t)) for i, t in rows}


def test_the_query_counts_with_a_stand_in_vocabulary(spark, documents):
    """The README gives the difference from the file's own tokenizer, which merges by rank."""
    from sentencepiece import SentencePieceProcessor

    exact, count = SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")), token_count.word_counter(token_count.vocabulary(P.path("piece_bpe_32k.model")))
    texts = [r["text"] for r in documents.where("text <> ''").orderBy("doc_id").limit(100).collect()]
    assert 1.1 < sum(count(w)[0] for t in texts for w in token_count.words(t)) / sum(len(exact.encode(t)) for t in texts) < 1.2


def test_ties_and_unknown_runs_without_bytes():
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram

    rng = np.random.default_rng(8)
    vocabulary = [("<unk>", 0.0)] + [(p, float(-rng.integers(1, 3))) for p in ["a", "b", "ab", "ba", "aa", "bb", "aba", "abb", "c", "bc"]]
    count = token_count.word_counter(vocabulary)
    exact = Tokenizer(Unigram(vocabulary, 0, byte_fallback=False))
    for _ in range(400):
        word = "".join(rng.choice(list("abcd"), int(rng.integers(1, 14))))
        assert count(word)[0] == len(exact.encode(word).ids), word


def pieces_of(rows, size=1024):
    from tokenizers import Tokenizer

    tokenizer, out = Tokenizer.from_file(P.path("byte_bpe_50k.json")), {}
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        over = len(ids) % size or size
        cuts = [0, *range(over, len(ids) + 1, size)]
        for i in range(len(cuts) - 1):
            part = np.array(ids[cuts[i] : cuts[i + 1]], dtype="<u4")
            out[d, i] = (cuts[i], len(part), zlib.crc32(part.tobytes()))
    return out


def check_packing(found, size):
    found = found.sort_values(["sequence_id", "offset"])
    by = found.groupby("sequence_id")["length"]
    assert (found["offset"] == by.cumsum() - found["length"]).all() and by.sum().max() <= size
    return by.ngroups


def test_packed_documents(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.limit(80).collect()]
    rows += [(10_000, None), (10_001, ""), (10_002, "a <|endoftext|> b"), (10_003, "x " * 1023), (10_004, "y " * 1024), (10_005, "ß日\r\n\t  𝒳 " * 700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    files = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    found = packing.packed_documents(docs, *files).toPandas()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in found.itertuples()} == pieces_of(rows)
    n = check_packing(found, 1024)
    assert n <= -(-found["length"].sum() // 1024) + 1
    assert packing.packed_documents(docs.limit(0), *files).count() == 0


def test_packing_of_repeated_and_equal_lengths(spark):
    rng = np.random.default_rng(5)
    rows = [(i, 0, 0, int(x), 0) for i, x in enumerate(np.concatenate((np.full(300, 5), rng.integers(1, 17, 200))))]
    rows += rows[:20] + [(None, 0, 0, 3, 0)] * 3
    pieces = spark.createDataFrame(rows, packing.PIECES)
    found = packing.pack(pieces, 16, bucket_rows=10, spread=4, most_rows=40).toPandas()
    assert len(found) == len(rows)
    assert check_packing(found, 16) <= -(-sum(r[3] for r in rows) // 16) + 12


def test_fillings_use_every_piece_once():
    rng = np.random.default_rng(6)
    for size in (8, 32, 100):
        lengths, n = np.unique(rng.integers(1, size + 1, 500), return_counts=True)
        left = dict(zip(lengths.tolist(), n.tolist()))
        plan = packing.fillings(left, size)
        used: dict = {}
        for bin_, times in plan:
            assert sum(bin_) <= size
            for x in bin_:
                used[x] = used.get(x, 0) + times
        assert used == left
        assert sum(t for _, t in plan) <= 1.02 * sum(k * v for k, v in left.items()) / size + sum(v for k, v in left.items() if k > 0.9 * size)
    assert packing.fillings({6: 1, 3: 1, 5: 1, 2: 1}, 8) == [([6, 2], 1), ([5, 3], 1)]


def brute_fullest(lengths, size):
    """The fullest bin that the longest length can be part of, by trying all subsets."""
    from itertools import combinations

    first, *rest = sorted(lengths, reverse=True)
    return max(first + sum(c) for k in range(len(rest) + 1) for c in combinations(rest, k) if first + sum(c) <= size)


def test_fillings_are_the_fullest():
    rng = np.random.default_rng(16)
    for _ in range(60):
        size = int(rng.integers(5, 40))
        lengths = rng.integers(1, size + 1, 9).tolist()
        left = list(lengths)
        for bin_, times in packing.fillings({x: lengths.count(x) for x in set(lengths)}, size):
            for _ in range(times):
                assert sum(bin_) == brute_fullest(left, size) and max(bin_) == max(left)
                for x in bin_:
                    left.remove(x)
        assert not left


def test_both_tokenizers_give_the_same_ids():
    from tokenizers import Tokenizer

    coder, exact = packing._coder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(17)
    pools = ["abc XYZ", " \t\n\r\u00a0\u3000\x0b", "0123456789", "'s't're.,;!?-()|<>", "éßñçøÅ", "日本語中文한국", "😀👍🏽🇩🇪\u200d\ufe0f", "\x00\x7f\u202e\ufeff\ue000", "<|endoftext|>"]
    for i in range(3000):
        some = [pools[int(j)] for j in rng.integers(0, len(pools), 3)]
        text = "".join(x if x.startswith("<|") and rng.random() < 0.1 else x[int(rng.integers(0, len(x)))] for x in (some[int(j)] for j in rng.integers(0, 3, int(rng.integers(1, 40)))))
        assert coder(text).tolist() == exact.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_reads_no_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 3, "x", 7)], "doc_id long, text string, length int, bucket string, sequence_id long")
    assert packing.packed_documents(docs, P.path("byte_bpe_50k.json")).count() == 1


def brute_links(rows, threshold=0.9):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault(i, np.array(v, dtype=np.float64) / max(map(abs, v)))
    ids = sorted(good)
    link = {i: {j for j in ids if j != i and len(good[i]) == len(good[j]) and good[i] @ good[j] / np.sqrt((good[i] @ good[i]) * (good[j] @ good[j])) >= threshold} for i in ids}
    group = {i: i for i in ids}
    for i in ids:
        for j in link[i]:
            low, high = sorted((group[i], group[j]))
            group = {d: low if g == high else g for d, g in group.items()}
    return {i: (len(link.get(i, ())), group.get(i, i)) for i, _ in rows if i is not None}


@pytest.mark.parametrize("groups", [1, 5])
def test_cosine_components(spark, groups, monkeypatch):
    if groups > 1:  # as if no more than some vectors fitted a task
        monkeypatch.setattr(embedding_dedup, "_ROWS", 7)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(8, 12))
    rows = [(i, (centres[i % 8] + rng.normal(size=12) * (0.15 if i % 3 else 0.45)).tolist()) for i in range(150)]
    rows += [(200 + i, [1.0] * 12) for i in range(25)] + [(230, [2.0] * 12), (231, [-1.0] * 12)]
    rows += [(300, None), (301, []), (302, [0.0] * 12), (303, [None] + [1.0] * 11), (304, [float("nan")] * 12), (305, [float("inf")] * 12), (306, [1.0, 2.0]), (307, [2.0, 4.0])]
    # finite vectors whose squares aren't
    rows += [(310, [1e200, 0.0, 0.0]), (311, [1e200, 1e195, 0.0]), (312, [1e-200, 0.0, 0.0]), (313, [1e-200, 1e-205, 0.0]), (314, [1e308, 1e308, 1e308]), (315, [5e-324, 5e-324, 5e-324]), (316, [0.0, 3.0, 0.0])]
    # pairs at the very threshold, which no codes decide
    rows += [(400 + i, [math.cos(x), math.sin(x), 0.0, 0.0, 0.0]) for i, x in enumerate((j + 1) * math.acos(0.9) + 1e-7 * rng.random() for j in range(8) for _ in range(3))]
    data = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<double>, label int, size string")
    options = {"tasks": 1} if groups == 1 else {"group_rows": 16}
    out = embedding_dedup.cosine_components(data, **options).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out} == brute_links(rows)
    assert all(r["kept"] == (r["component_id"] == r["vec_id"]) for r in out)
    assert embedding_dedup.cosine_components(data.limit(0)).count() == 0


def test_cosine_null_ids_and_repeats(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [1.0, 0.01])]
    found = embedding_dedup.cosine_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted(map(tuple, found), key=str) == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 0, None, False)], key=str)
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.01, 1.0]), (3, [1.0, 0.01])]  # one id, two vectors
    found = embedding_dedup.cosine_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted(map(tuple, found)) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]


def test_group_products_against_all_pairs(monkeypatch):
    monkeypatch.setattr(embedding_dedup, "_ROWS", 9)
    rng = np.random.default_rng(12)
    raw = np.repeat(rng.normal(size=(20, 16)), 6, axis=0) + rng.normal(size=(120, 16)) * rng.choice([1e-3, 0.2, 0.45], (120, 1))
    rows = pa.RecordBatch.from_arrays([pa.array(range(120)), pa.array(rng.integers(1, 4, 120)), pa.array(raw.tolist())], names=["class", "size", "v"])
    x = embedding_dedup._group(pa.Table.from_batches(embedding_dedup.coded([rows])), 16)
    part = lambda s: {k: v[s] for k, v in x.items()}
    exact = embedding_dedup.unit(raw) @ embedding_dedup.unit(raw).T >= 0.9
    for a, b, same in ((slice(0, 120), slice(0, 120), True), (slice(0, 50), slice(50, 120), False)):
        left, right = part(a), part(b)
        links_x, links_y, label, p, q = embedding_dedup.group_links(left, right, 0.9, same)
        want = np.triu(exact, 1) if same else exact[a, b]
        lost = np.zeros_like(want)
        lost[p, q] = want[p, q]  # open pairs are left to full precision
        sure = want & ~lost
        assert (links_x == sure @ right["size"]).all() and (links_y == left["size"] @ sure).all()
        assert len(p) < 5


def test_error_bounds_hold():
    rng = np.random.default_rng(1)
    raw = rng.normal(size=(300, 20)) * rng.random((300, 1)) * 10
    x = embedding_dedup.unit(raw)
    assert np.allclose(x, raw / np.linalg.norm(raw, axis=1, keepdims=True))
    codes, scale, rest = embedding_dedup.quantised(x)
    fine, fine_scale, last = embedding_dedup.quantised(rest)
    for about, left in ((codes * scale[:, None], rest), (codes * scale[:, None] + fine * fine_scale[:, None], last)):
        error = np.linalg.norm(left, axis=1)
        assert (np.abs(x @ x.T - about @ about.T) <= error[:, None] + (1 + error[:, None]) * error[None] + 1e-12).all()


def test_warc_round_trip(spark, sf_dir, tmp_path):
    import gzip

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    records = warc.responses(pages)
    derived = warc.derive(records)
    rows, sources = derived.collect(), {r["record_id"]: r for r in records.collect()}
    assert len(rows) == 2 * pages.count() and len({r["record_id"] for r in rows}) == len(rows)
    for r in rows:
        source = sources[r["refers_to"]]
        (fields, head, block), = warc.parsed([warc.serialised(r["headers"], r["content"].encode())])
        assert head == r["headers"] and block.decode() == r["content"]
        assert fields["warc-refers-to"] == source["record_id"] and fields["warc-target-uri"] == " ".join(source["target_uri"].split())
        assert fields["warc-block-digest"] == warc.digest(block) and int(fields["content-length"]) == len(block) == r["content_length"]
        assert f"WARC-Payload-Digest: {r['source_payload_digest']}\r\n" in source["headers"]
        assert r["source_block_digest"] == warc.digest(source["block"])
        assert "<p" not in r["content"]
    data = b"".join(warc.serialised(s["headers"], s["block"]) for s in sources.values())
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(data))
    again = warc.derive(warc.read_responses(spark, str(tmp_path))).drop("page_id")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, derived.drop("page_id").collect()))


def test_warc_files_are_read_as_streams(spark, tmp_path):
    inner = b"HTTP/1.1 200 OK\r\n\r\n<p>an archive in a page\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\nand after\xff\x00"
    record = lambda name, block, kind="response": b"WARC/1.1\r\nwarc-type: %s\r\nWARC-RECORD-ID: %s\r\nwarc-target-uri: http://a/\r\nWarc-Date: d\r\nWarc-Payload-Digest: sha1:KEPT\r\ncontent-length: %d\r\n\r\n%s\r\n\r\n" % (kind.encode(), name, len(block), block)
    blocks = {b"<r%d>" % i: inner if i == 3 else b"HTTP/1.1 200 OK\r\n\r\n<p>page %d" % i for i in range(9)}
    data = record(b"<info>", b"x", "warcinfo") + b"".join(record(n, b) for n, b in blocks.items())
    (tmp_path / "gz").mkdir()
    (tmp_path / "gz" / "a.warc.gz").write_bytes(b"".join(gzip.compress(data[i : i + 300]) for i in range(0, len(data), 300)))
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "b.warc").write_bytes(data)
    (tmp_path / "plain" / "c.warc").write_bytes(record(b"<cut>", b"HTTP/1.1 200 OK\r\n\r\n<p>the end is missing")[:-15])
    for folder, more in (("gz", {}), ("plain", {b"<cut>": None})):
        found = warc.read_responses(spark, str(tmp_path / folder)).collect()
        assert {r["record_id"] for r in found} == {x.decode() for x in [*blocks, *more]}
        assert all(bytes(r["block"]) == blocks[r["record_id"].encode()] for r in found if r["record_id"].encode() in blocks)
    text = {r["refers_to"]: r for r in warc.derive(warc.read_responses(spark, str(tmp_path / "plain"))).where("record_type = 'conversion'").collect()}
    assert text["<r1>"]["content"] == "page 1" and text["<r1>"]["source_payload_digest"] == "sha1:KEPT" and text["<cut>"]["content"] == "the end"
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "d.warc").write_bytes(b"")
    assert warc.read_responses(spark, str(tmp_path / "none")).count() == 0


class Reader(HTMLParser):
    """An independent reader: text by block element, and links."""

    blocks = set("p div br li ul ol dl dt dd h1 h2 h3 h4 h5 h6 tr td th table article section aside nav header footer main body html blockquote pre hr form figure".split())

    def __init__(self):
        super().__init__()
        self.lines, self.links, self.hidden = [""], [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "noscript", "template", "head")
        if tag in self.blocks:
            self.lines.append("")
        if tag == "a" and dict(attrs).get("href"):
            self.links.append(dict(attrs)["href"].strip())

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "noscript", "template", "head")
        if tag in self.blocks:
            self.lines.append("")

    def handle_data(self, data):
        if not self.hidden:
            self.lines[-1] += data


def test_texts_and_links_equal_an_independent_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r["page_id"]: (r["url"], r["html"]) for r in pages.collect()}
    for r in warc.derive(warc.responses(pages)).collect():
        reader = Reader()
        reader.feed(html[r["page_id"]][1])
        reader.close()
        if r["record_type"] == "conversion":
            lines = (" ".join(x.split()) for x in reader.lines)
            assert r["content"] == "\n".join(x for x in lines if x), r["page_id"]
        else:
            links = [x[len("outlink: ") :] for x in r["content"].split("\r\n") if x.startswith("outlink: ")]
            assert links == list(dict.fromkeys(urljoin(html[r["page_id"]][0], x) for x in dict.fromkeys(reader.links)))


def test_warc_odd_pages(spark):
    rows = [(1, None, None, "x"), (2, "http://a/", "", "y"), (None, "http://a/b", "<p>A&amp;B<br>c <!-- no --><script>var x='<p>';", None), (3, "http://[bad", '<a href="http://[x">l</a><a href=q>', None)]
    found = warc.derive(warc.responses(spark.createDataFrame(rows, "page_id long, url string, html string, record_id string"))).collect()
    assert len(found) == 8
    assert [r["content"] for r in found if r["record_type"] == "conversion" and r["page_id"] is None] == ["A&B\nc"]
    assert warc.derive(warc.responses(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0
    plain = warc.derived(1, "<r>", "u", "d", "WARC/1.1\r\nWARC-Payload-Digest: sha1:KEPT\r\nWARC-IP-Address: 1.2.3.4\r\n", "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\n\r\n<p>é".encode("latin-1"))
    assert plain[1][12] == "é" and plain[1][9] == "sha1:KEPT" and "WARC-IP-Address: 1.2.3.4" in plain[1][11]


def test_features_of_empty_texts():
    x = quality.features(pa.array(["", None, "A b. c!", "日本"]))
    assert (x[:2] == 0).all() and x.shape == (4, len(quality.FEATURES))


@pytest.mark.parametrize(
    "page,text",
    [
        ("<html><head><title>x</title><body><p>All of the text</p></body></html>", "All of the text"),
        ("<head><meta charset=utf-8><title>x <p></title><script>'<body>'</script><div>a</div>b", "a\nb"),
        ("<head><title>x</title>Only <b>text</b>", "Only text"),
        ("<head><title>x <!-- y</title></head><body>a", "a"),
        ("<head><style>p {}</style><!-- <p> --></head>a", "a"),
        ("<head><title>x</title></head><body>a<svg><title>b</title></svg>", "ab"),
        ("<header>a</header><p>b<noscript>c<p>d", "a\nbc\nd"),
        ("<p>a<template>b<p>c</p>", "ab\nc"),
        ("<p>a<noscript>b</noscript>c<template>d</template>e", "a c e"),
        ("<p>a<script>b", "a"),
        ("<p>a<!-- b", "a"),
    ],
)
def test_plain_text_of_pages_with_open_elements(page, text):
    assert warc.plain_text(page) == text


@pytest.mark.parametrize(
    "part, times",
    [("<noscript>", 20_000), ("<template>", 20_000), ("<title>", 20_000), ("<head>", 5_000), ("<head><title>", 5_000), ("<a ", 20_000), ("<script ", 20_000), ("<!--", 20_000),
     ("<a href='", 20_001), ("<head></title>", 9_000), ("<p ", 30_000), ("<head><!-- --><p", 9_000), ("<a href=>", 20_000)],
)
def test_open_elements_cost_no_more_than_their_length(part, times):
    began = time.perf_counter()
    assert len(warc.derived(1, "<r>", "http://u/", "d", "", b"HTTP/1.1 200 OK\r\n\r\n" + (part * times).encode())) == 2
    assert time.perf_counter() - began < 1


def test_titles_and_links_of_pages_with_open_elements():
    page = "<!-- <title>a</title> <a href=1> --><a <a href=2><a x href='3>' href=4><a href=\"5'><title>b"
    assert warc.Elements(page).title == "a" and warc.links(page) == ["1", "2", "'3>'"]
    assert warc.links('<a href= "x y" ><A HREF=z>') == ['"x y"', "z"] and warc.links("<abbr href=1><a>href=2") == []


def chunked(data, n=7):
    return b"".join(b"%x;e=1\r\n%s\r\n" % (len(data[i : i + n]), data[i : i + n]) for i in range(0, len(data), n)) + b"0\r\nT: x\r\n\r\n"


def test_coded_payloads():
    page = ("<p>" + "Ein schöner Satz. " * 50).encode()
    want = warc.plain_text(page.decode())
    packed = gzip.compress(page)
    raw = zlib.compressobj(wbits=-15)
    raw = raw.compress(page) + raw.flush()
    for head, body in [
        ("Transfer-Encoding: chunked", chunked(page)),
        ("Content-Encoding: gzip", packed),
        ("content-encoding: x-gzip", gzip.compress(page[:99]) + gzip.compress(page[99:])),
        ("Content-Encoding: deflate", zlib.compress(page)),
        ("Content-Encoding: deflate", raw),
        ("Transfer-Encoding: gzip, chunked", chunked(packed)),
        ("Transfer-Encoding: chunked\r\nContent-Encoding: gzip", chunked(packed)),
        ("Transfer-Encoding: chunked\r\nContent-Encoding: gzip", page),  # already undone, as some crawlers store it
    ]:
        metadata, conversion = warc.derived(1, "<r>", "u", "d", "WARC/1.1\r\n", f"HTTP/1.1 200 OK\r\n{head}\r\n\r\n".encode() + body)
        assert conversion[-1] == want, head
        assert metadata[10] == warc.digest(f"HTTP/1.1 200 OK\r\n{head}\r\n\r\n".encode() + body)
        if head.endswith("chunked\r\nContent-Encoding: gzip"):
            assert metadata[9] == warc.digest(packed if body != page else page)
    cut = warc.derived(1, "<r>", "u", "d", "", b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n" + packed[:-12])
    assert cut[1][-1].startswith("Ein")
