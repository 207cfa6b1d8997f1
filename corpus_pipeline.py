"""A corpus from raw documents to packed training sequences, in five stages.

Each stage takes the documents that its predecessor kept, as a Parquet table, and returns those that it
keeps with the columns of `documents`; the last returns token pieces with their places.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import decontaminate, language, line_dedup, ngram_join, packing
from larder.llm.common import crc_remainder, fresh, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language. Those go that have no letter or no text, or that are no likelier than
    noise under the best mixture, of however many languages. A null lang becomes the
    language found; others stay as they are."""
    model = language.fit(docs.where(crc_remainder("doc_id") != 1))
    lang, gain = fresh(docs.columns, "lang_pred", "gain")
    found = language.predict(docs, model, out={"lang_pred": lang, "gain": gain})
    kept = found.where((F.col(lang) != language.UNKNOWN) & (F.col(gain) > 0))
    return kept.withColumn("lang", F.coalesce("lang", lang)).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines, which are compared without white space at their ends. A
    document goes if lines were removed and no more than white space is left: all of it stands elsewhere."""
    out, gone = line_dedup.cleaned(docs, white=" \t\r\n")
    out = out.where(F.col(gone).isNull() | F.col("text").rlike(r"(?U)\S")).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group that links of similarity 0.75 hold together;
    one row of those that are alike in id and text. Documents without words all stay."""
    return ngram_join.deduplicated(docs)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than half of any benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of at most 1,024 tokens."""
    return packing.packed_documents(
        docs,
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", dedup_documents),
    ("benchmark_decontamination", decontaminate_documents),
    ("best_fit_packing", pack_documents),
]

#: Mixture inference, sketches and packing are beyond SQL; tests hold the operators of the stages, and what
#: the stages do beyond them, against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
