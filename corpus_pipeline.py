"""From raw documents to packed training sequences, stage by stage.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its
predecessor kept; its result is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from metricweave.llm.columns import with_columns
from metricweave.llm.decontaminate import find_contamination
from metricweave.llm.packing import pack
from metricweave.llm.pii import find_pii, mask_pii
from metricweave.llm.quality import quality_rules
from metricweave.llm.simhash import near_duplicates
from metricweave.session import store


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule."""
    return quality_rules(docs).where("kept").select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return near_duplicates(docs, shingle=3, radius=3).where("chosen").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find_contamination(docs, benchmark).where("NOT contaminated").select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked and the length counted anew."""
    masked = mask_pii(find_pii(docs))
    changed = {"n_chars": F.length("text").cast("bigint")} if "n_chars" in docs.columns else {}
    return with_columns(masked, changed).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    import public_tokenizers  # only this stage needs the vocabulary files

    return pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality),
    ("simhash near-dedup", near_copies),
    ("benchmark decontamination", decontamination),
    ("pii", personal_data),
    ("packing", packing),
]

#: SQL can express neither the fingerprints nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
