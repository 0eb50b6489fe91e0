"""Registered queries of the operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, language_id, lengths, license_markup, linededup, packing, periodic, quality, styletree, superminhash, warc, whitening

Builder = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict[str, Builder] = {
    "op1_packing": lambda s, d: packing.pack(table(s, d, "documents")),
    "op2_decontamination": lambda s, d: decontam.contamination_report(table(s, d, "documents"), table(s, d, "benchmark")),
    "op3_line_dedup": lambda s, d: linededup.line_dedup_report(table(s, d, "documents")),
    "op4_minhash_near_dup": lambda s, d: superminhash.near_dup_report(table(s, d, "documents")),
    "op5_html_extraction": lambda s, d: styletree.extraction_report(table(s, d, "pages")),
    "op6_license_scan": lambda s, d: license_markup.license_report(table(s, d, "documents")),
    "op7_warc_transactions": lambda s, d: warc.warc_report(table(s, d, "pages")),
    "op8_quality_divergence": lambda s, d: quality.quality_report(table(s, d, "documents")),
    "op9_token_histogram": lambda s, d: lengths.token_histogram_report(table(s, d, "documents")),
    "op10_chat_format": lambda s, d: chat.chat_report(table(s, d, "conversations")),
    "op11_periodic_runs": lambda s, d: periodic.run_report(table(s, d, "documents")),
    "op12_embedding_whitening": lambda s, d: whitening.whitening_report(table(s, d, "embeddings")),
    "op13_language_id": lambda s, d: language_id.language_report(table(s, d, "documents")),
}

ORACLES: dict[str, str] = {
    "op2_decontamination": decontam.ORACLE,
    "op3_line_dedup": linededup.ORACLE,
    "op4_minhash_near_dup": superminhash.ORACLE,
    "op7_warc_transactions": warc.ORACLE,
    "op8_quality_divergence": quality.ORACLE,
    "op10_chat_format": chat.ORACLE,
    "op11_periodic_runs": periodic.ORACLE,
}
