"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its
predecessor kept. All but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logvane.llm import bin_completion, quality_fm, secret_lexer, simhash_windows, trie_join
from logvane.llm.queries import tokenizer_path
from logvane.session import materialize

#: near duplicates: five-word shingles, Jaccard similarity of at least 0.8
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine does not reject; it learns from all labelled ones."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    meta = ("n_chars",)
    return quality_fm.keep_good(docs, quality_fm.fit(docs, labels, meta=meta), meta=meta)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    return trie_join.keep_one(docs, size=SHINGLE_WORDS, percent=SIMILARITY_PERCENT)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy or near copy of a benchmark item."""
    return simhash_windows.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets blacked out."""
    return secret_lexer.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return bin_completion.pack(bin_completion.cut(docs.select("doc_id", "text"), tokenizer_path()))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]
#: a trained classifier, tokenizers and a packing decide here, which SQL cannot express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; every stage's rows are written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "_"))
    return docs
