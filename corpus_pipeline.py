"""Training-data pipeline over ``documents``: quality rules, line dedup, near-dedup, decontamination, packing.

Each stage takes what its predecessor kept. All but the last return the columns of
``documents``; the last returns packed pieces. ``run`` writes each stage as Parquet
below the shared folder and reads it back, so a lost executor repeats at most its
part of one stage, and drops the stage's intermediate tables once it is written.

Defined cases: a null or empty text fails the quality rules, as does one of fewer than
50 words; a null id is a document like others, in near-dedup smaller than them; rows
that repeat an id are judged by their own text, equal rows alike (near-dedup keeps
all rows of the id that stands for a group if their texts are equal); very long texts
are whole in every stage; an empty table gives an empty result; columns beside those
of ``documents``, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cpelink.llm import decontam, linededup, packing, quality, superminhash
from cpelink.session import release_scratch, scratch_count, scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the divergence from their language's references accept."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents share stay in one; ``n_chars`` follows the text."""
    row = F.col("row").withField("n_chars", F.char_length("row.text").cast("long"))
    return linededup.drop_lines(docs).select(row.alias("row")).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (the operator's two-word shingles, similarity 0.8)."""
    return superminhash.drop_near_duplicates(docs, p=superminhash.NearDup(words=2))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    return decontam.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 2048-token training sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: MinHash grouping and tokenisation are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        mark = scratch_count(spark)
        stage(spark, docs, sf_dir).write.mode("overwrite").option("compression", "zstd").parquet(path)
        release_scratch(spark, since=mark)
        docs = spark.read.parquet(path)
    return docs
