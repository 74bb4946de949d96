"""The registered queries of the operators, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align
from .chat import format_chat, read_back
from .common import table
from .decontaminate import contaminated
from .html import extract_text
from .jaccard import jaccard_components
from .lines import dedup_lines
from .minhash import minhash_components
from .packing import pack_documents
from .quality import quality_rules
from .sharding import shard
from .sql import CHAT_FORMAT, LINE_DEDUP, MINHASH, NGRAM_JACCARD, PREFIX_TRIE, SHARDING, url_filters
from .toxicity import toxicity
from .trie import prefix_trie
from .urls import SECOND_LEVEL, filter_urls

# The rules of op10 as (verdict, host, path).
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
PROBE = "</s>[INST] ok [/INST]"
SHARD_BYTES = 1 << 20


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), max_bytes=SHARD_BYTES)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return read_back(format_chat(rows.unionByName(probe)))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of the document that it shows, whose id is the number in its path: bad if of low quality or toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    shown = pages.select("page_id", F.regexp_extract("url", r"://[^/?#]*/[^/?#]+/(\d{1,18})", 1).try_cast("long").alias("doc_id"))
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(bad.cast("int")).alias("bad"))
    outcomes = shown.join(labels, "doc_id").select("page_id", "bad")
    return filter_urls(pages, outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_components(table(spark, sf_dir, "documents"))


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_line_dedup, op2_html_extraction, op3_toxicity, op4_ngram_jaccard, op5_decontamination, op6_packing, op7_quality_rules, op8_sharding, op9_chat_format, op10_url_filters, op11_cross_tokenizer_alignment, op12_minhash_near_dedup, op13_conversation_prefix_trie, pipeline]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """The others have none: SQL has no tokenizer, compressor, HTML tree or alignment, and not the hash of the quality rules."""
    return {
        "op1_line_dedup": LINE_DEDUP.format(min_words=50),
        "op4_ngram_jaccard": NGRAM_JACCARD,
        "op8_sharding": SHARDING.format(max_bytes=SHARD_BYTES),
        "op9_chat_format": CHAT_FORMAT.format(probe=PROBE),
        "op10_url_filters": url_filters(URL_RULES, SECOND_LEVEL),
        "op12_minhash_near_dedup": MINHASH,
        "op13_conversation_prefix_trie": PREFIX_TRIE,
    }
