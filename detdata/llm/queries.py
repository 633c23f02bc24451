"""The registered queries of this package: each applies one operator, with production parameters, to its
whole table and derives the contract's columns from what the operator returns."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repair_codec, sql
from .common import read
from .decontam import contaminated
from .fill_in_middle import fill_in_middle, restored
from .html_template import extract_text
from .language_masks import identify_held_out
from .line_dedup import dedup_lines
from .ordinal_quality import grade_documents
from .quality_rules import quality_rules
from .shingle_join import similar_components
from .source_divergence import source_divergence
from .source_mix import mix_sources
from .token_spans import section_tokens
from .url_trust import judge_urls


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_repair_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_codec.encode(read(spark, sf_dir, "documents"), tokenizer_path())


def op2_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(read(spark, sf_dir, "documents"), k=4, num=85, den=100).select("doc_id", "n_shingles", "component_id")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op5_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = section_tokens(read(spark, sf_dir, "documents"), tokenizer_path(), rule="most")
    return out.select("doc_id", "section", "start", "stop", F.col("n_tokens").cast("long").alias("n_tokens"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 toxic, 1 poor, 2 good; kept are the documents that are likely good."""
    labels = read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, 0).otherwise(1 + F.col("quality")).alias("grade"))
    return grade_documents(read(spark, sf_dir, "documents"), labels)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(read(spark, sf_dir, "documents"))
    digests = {"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(restored(F.col("form"), F.col("output")), 256)}
    return out.withColumns(digests).drop("output")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read(spark, sf_dir, "documents"))


def op13_language_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_held_out(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repair_token_shards": op1_repair_token_shards,
    "op2_url_trust": op2_url_trust,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_line_dedup": op4_line_dedup,
    "op5_section_tokens": op5_section_tokens,
    "op6_quality_rules": op6_quality_rules,
    "op7_html_extraction": op7_html_extraction,
    "op8_source_mix": op8_source_mix,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_ordinal_quality": op10_ordinal_quality,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_source_divergence": op12_source_divergence,
    "op13_language_masks": op13_language_masks,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op2_url_trust": sql.OP2,
    "op3_ngram_jaccard_join": sql.OP3,
    "op4_line_dedup": sql.OP4,
    "op6_quality_rules": sql.OP6,
    "op11_fill_in_middle": sql.OP11,
    "op12_source_divergence": sql.OP12,
}
