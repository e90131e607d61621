"""A training corpus from ``documents``: quality, near duplicates, repeated passages, leaked benchmarks, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; between stages the documents are
written to the shared folder as Parquet and read again.  Stages judge rows, not ids: rows without an id, with the id of
another row, with null, empty or very long texts, repeated rows and further columns all pass through with a defined
result, which each stage states; an empty table gives an empty one everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronopanel.llm import bpe, compact_windows, decontaminate, quality, simhash
from chronopanel.llm.common import cut, table, unique_ids


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are neither low quality nor toxic by the co-trained classifier, with all columns.

    Each row is scored by its own text and metadata, so rows that are alike are kept or dropped alike; a null text is an
    empty one, missing metadata a value of its own.  Without labels everything is kept."""
    return quality.kept_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts of which five-word shingles are at least 0.8 alike, that with the smallest id.

    Rows without an id or with a repeated one come after those with their own.  Equal texts are copies, null and empty
    ones too, so one of them stays; ties are broken by the row's number."""
    return simhash.first_of_each_component(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the passages of 50 words that a row of a smaller id has.

    Rows without an id or with a repeated one come after those with their own, and each loses its own passages only.
    Null, empty and shorter texts stay as they are; of repeated rows the first keeps its text."""
    rows = unique_ids(docs)
    found = compact_windows.repeated_passages(rows, id_col="__row")
    return compact_windows.remove_passages(rows, found, id_col="__row").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text has no occurrence of a benchmark item within its edit budget; null and empty texts stay."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and packed byte-level BPE ids of each row; null and empty texts have no tokens."""
    return bpe.encode(docs, *bpe.default_vocabulary())


STAGES = [
    ("quality_classifier", keep_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_level_bpe", tokenize),
]

#: SQL can't express these stages; tests/llm/test_pipeline.py holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over all documents; the tokens of what is left."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
