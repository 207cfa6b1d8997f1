"""The queries of this subpackage, opN_<name> each, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larder.llm.line_dedup import remove_boilerplate

    return remove_boilerplate(_table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from larder.llm.packing import packed_documents

    return packed_documents(
        _table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    )


QUERIES = {"op5_line_dedup": op5_line_dedup, "op9_best_fit_packing": op9_best_fit_packing}

SQL = {
    "op5_line_dedup": """
        WITH l AS (
          SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
                 unnest(range(len(string_split(text, chr(10))))) AS pos
          FROM documents WHERE text IS NOT NULL),
        c AS (
          SELECT trim(line) AS line, min((doc_id, pos)) AS first_place
          FROM l WHERE trim(line) <> ''
          GROUP BY trim(line) HAVING count(DISTINCT coalesce(source, chr(1))) >= 5),
        m AS (
          SELECT l.doc_id, l.pos, l.line, c.line IS NOT NULL AND (l.doc_id, l.pos) <> c.first_place AS gone
          FROM l LEFT JOIN c ON trim(l.line) = c.line)
        SELECT d.doc_id,
               CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text,
               coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed
        FROM documents d LEFT JOIN (
          SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS text,
                 count(*) AS n_lines, count(*) FILTER (gone) AS n_removed
          FROM m GROUP BY doc_id) k USING (doc_id)
    """,
}


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larder.llm.ngram_join import ngram_components

    return ngram_components(_table(spark, sf_dir, "documents"))


QUERIES["op8_ngram_jaccard_join"] = op8_ngram_jaccard_join


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larder.llm.language import identify

    return identify(_table(spark, sf_dir, "documents"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larder.llm.decontaminate import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES |= {"op1_language_id": op1_language_id, "op10_benchmark_decontamination": op10_benchmark_decontamination}


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of a BPE model, with merge ranks for scores, stand in for a unigram vocabulary: none is
    at hand. Counts are not those of the model's own tokenizer."""
    import public_tokenizers as P

    from larder.llm.token_count import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), P.path("piece_bpe_32k.model"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larder.llm.license_scan import license_digest

    return license_digest(_table(spark, sf_dir, "documents"))


QUERIES |= {"op2_token_counts": op2_token_counts, "op4_license_scan": op4_license_scan}


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larder.llm.embedding_dedup import cosine_components

    return cosine_components(_table(spark, sf_dir, "embeddings"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larder.llm.quality import score_documents

    return score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES |= {"op6_embedding_near_dedup": op6_embedding_near_dedup, "op7_quality_classifier": op7_quality_classifier}


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larder.llm.warc import derive, responses

    return derive(responses(_table(spark, sf_dir, "pages")))


QUERIES |= {"op3_warc_derivatives": op3_warc_derivatives}


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larder.llm.vector_codes import code_digest

    return code_digest(_table(spark, sf_dir, "embeddings"))


def op12_repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from larder.llm.repair import documents_of, read_shards, write_shards

    docs = _table(spark, sf_dir, "documents")
    _, path = write_shards(docs, P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    return documents_of(read_shards(spark, path))


QUERIES |= {"op11_vector_codes": op11_vector_codes, "op12_repair_shards": op12_repair_shards}


def _codes_sql(rounds: int = 2) -> str:
    """Parts of four components (vectors of 64), 16 codebooks of 64 entries."""
    places = range(4)
    distance = " + ".join(f"(x{i} - c{i}) * (x{i} - c{i})" for i in places)
    steps = [f"""
        v AS (SELECT vec_id, label, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
        u AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS pos, floor(256 * unnest(embedding)::DOUBLE)::BIGINT AS n FROM v),
        x AS (SELECT vec_id, any_value(label) AS label, pos // 4 AS p, {', '.join(f'max(n) FILTER (pos % 4 = {i}) AS x{i}' for i in places)} FROM u GROUP BY vec_id, pos // 4),
        o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v),
        c0 AS (SELECT p, e, {', '.join(f'x{i} AS c{i}' for i in places)} FROM x JOIN o USING (vec_id) WHERE e < 64)"""]  # fmt: skip
    for r in range(rounds + 1):
        steps.append(f"a{r} AS (SELECT vec_id, p, min(({distance}, e)) AS m FROM x JOIN c{r} USING (p) GROUP BY vec_id, p)")
        if r < rounds:
            means = ", ".join(f"coalesce(floor(sum(x{i}) / count(x{i})), any_value(c{i}))::BIGINT AS c{i}" for i in places)
            steps.append(f"c{r + 1} AS (SELECT c.p, c.e, {means} FROM c{r} c LEFT JOIN (a{r} JOIN x USING (vec_id, p)) ON c.p = x.p AND c.e = m[2] GROUP BY c.p, c.e)")
    books = "string_agg(" + " || ',' || ".join(f"c{i}" for i in places) + ", ',' ORDER BY p, e)"
    return f"""
        WITH {', '.join(steps)},
        f AS (SELECT vec_id, string_agg(printf('%02x', m[2]), '' ORDER BY p) AS code, sum(m[1])::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256({books}) FROM c{rounds}) AS codebooks_sha256
        FROM f JOIN v USING (vec_id)
    """  # fmt: skip


SQL["op11_vector_codes"] = _codes_sql()


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from larder.llm.hard_negatives import hard_negatives

    vec_id, label = F.col("vec_id"), F.col("label")
    rows = _table(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.transform("embedding", lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), F.floor(256 * x.cast("double")))).cast("array<double>").alias("vector"),
    )
    found = hard_negatives(rows, vec_id % 50 == 0)
    return found.withColumns({c: F.col(c).cast("long") for c in ("positive_score", "negative_score")})


QUERIES["op13_hard_negatives"] = op13_hard_negatives
SQL["op13_hard_negatives"] = """
    WITH k AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
               FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
          FROM k a JOIN k b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
    p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
           id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 3
"""


#: What can be reached from each node by `links` (a, b), which hold both directions.
_REACHED = "reach AS (SELECT id AS node, id AS other FROM nodes UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.other = links.a)"

SQL["op6_embedding_near_dedup"] = f"""
    WITH RECURSIVE nodes AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v,
                  len(embedding) > 0 AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS good FROM embeddings),
    links AS (SELECT a.id AS a, b.id AS b FROM nodes a JOIN nodes b ON a.id <> b.id AND len(a.v) = len(b.v) WHERE a.good AND b.good AND list_cosine_similarity(a.v, b.v) >= 0.9),
    {_REACHED}
    SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = id) AS n_links, c.component_id, id = c.component_id AS kept
    FROM nodes JOIN (SELECT node, min(other) AS component_id FROM reach GROUP BY 1) c ON node = id
"""

# Similar sets share one of their rarest quarter of shingles.
SQL["op8_ngram_jaccard_join"] = f"""
    WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    u AS (SELECT id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
    g AS (SELECT id, x || ' ' || lead(x, 1) OVER q || ' ' || lead(x, 2) OVER q || ' ' || lead(x, 3) OVER q || ' ' || lead(x, 4) OVER q AS s FROM u WINDOW q AS (PARTITION BY id ORDER BY i)),
    d AS (SELECT DISTINCT id, s FROM g WHERE s IS NOT NULL UNION ALL SELECT id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4),
    t AS (SELECT id, s, count(*) OVER (PARTITION BY id) AS n FROM d),
    nodes AS (SELECT w.id, coalesce(n, 0) AS n FROM w LEFT JOIN (SELECT id, count(*) AS n FROM d GROUP BY id) k ON w.id = k.id),
    p AS (SELECT t.* FROM t JOIN (SELECT s, count(*) AS c FROM t GROUP BY s) USING (s) QUALIFY row_number() OVER (PARTITION BY id ORDER BY c, s) <= n - (75 * n + 99) // 100 + 1),
    near AS (SELECT DISTINCT x.id AS a, y.id AS b FROM p x JOIN p y ON x.s = y.s AND x.id < y.id AND 100 * y.n >= 75 * x.n AND 100 * x.n >= 75 * y.n),
    one AS (SELECT a, b FROM near JOIN t x ON a = x.id JOIN t y ON b = y.id AND x.s = y.s GROUP BY a, b HAVING 100 * count(*) >= 75 * (any_value(x.n) + any_value(y.n) - count(*))),
    links AS (SELECT a, b FROM one UNION ALL SELECT b, a FROM one),
    {_REACHED}
    SELECT id AS doc_id, n AS n_shingles, component_id FROM nodes JOIN (SELECT node, min(other) AS component_id FROM reach GROUP BY 1) ON node = id
"""
