"""The registered queries of this subpackage: one for each operator, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import byte_bpe, embedding_dedup, exact_dedup, html_text, language_id, packing, quality_classifier, quality_rules, simhash, source_audit, toxicity, vector_codes
from .common import table
from .sharding import histogram_shards


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    out = histogram_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def pipeline(spark, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "pipeline": pipeline,
        "op1_quality_classifier": quality_classifier.op1_quality_classifier,
        "op2_language_id": language_id.op2_language_id,
        "op3_simhash": simhash.op3_simhash,
        "op4_embedding_dedup": embedding_dedup.op4_embedding_dedup,
        "op5_packing": packing.op5_packing,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_html_text": html_text.op7_html_text,
        "op8_quality_rules": quality_rules.op8_quality_rules,
        "op9_byte_bpe": byte_bpe.op9_byte_bpe,
        "op10_sharding": op10_sharding,
        "op11_exact_dedup": exact_dedup.op11_exact_dedup,
        "op12_source_audit": source_audit.op12_source_audit,
        "op13_vector_codes": vector_codes.op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_embedding_dedup": embedding_dedup.ORACLE_SQL,
        "op8_quality_rules": quality_rules.ORACLE_SQL,
        "op11_exact_dedup": exact_dedup.ORACLE_SQL,
        "op12_source_audit": source_audit.ORACLE_SQL,
        "op13_vector_codes": vector_codes.ORACLE_SQL,
    }
