"""The registered queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewatch.llm import (align, decontaminate, filter_audit, line_dedup, lm_score, mixing, quality, sharding, shingle_join, simhash, substring_dedup,
                            token_blocks, url_filter)
from tradewatch.llm.common import table, written

#: File of a public tokenizer, found by name; a parameter of the token query.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", "slot", "shard")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    prints = written(docs.select("doc_id", simhash.fingerprints(width=3)(F.col("text")).alias("fp")), "prints")
    out = simhash.near_duplicates(prints, "doc_id", max_distance=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"), length=400)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_removed") > 0).alias("touched"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), drop_text=True)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, table(spark, sf_dir, "labels")).select("page_id", "host", "path", "rule", "verdict")


def op6_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.encode_and_read_back(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), known_words=1_200_000)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.summary(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.with_verdict(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items",
                      decontaminate.sha256_of_list(F.col("contamination")["items"]).alias("items_sha256"), "contaminated")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_score.score(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumn("log_score", F.round("log_score", 3))


def op10_lm_score_order3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_score.score(table(spark, sf_dir, "documents").select("doc_id", "text"), order=3)
    return out.withColumn("log_score", F.round("log_score", 3))


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shingle_join.near_duplicates(docs, width=3, num=9, den=10).select("doc_id", "n_shingles", "component_id")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = align.align(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {f.__name__: f for f in (op1_sharding, op2_simhash_near_dedup, op3_suffix_dedup, op4_quality_rules, op5_url_filters, op6_token_blocks,
                                 op7_mixing, op8_line_dedup, op9_decontamination, op10_lm_score, op10_lm_score_order3,
                                 op11_ngram_jaccard_join, op12_filter_audit, op13_tokenizer_alignment)}

SQL = {"op1_sharding": sharding.SQL, "op5_url_filters": url_filter.SQL, "op7_mixing": mixing.SQL, "op8_line_dedup": line_dedup.SQL,
       "op10_lm_score": lm_score.SQL, "op10_lm_score_order3": lm_score.SQL_ORDER3, "op11_ngram_jaccard_join": shingle_join.SQL,
       "op12_filter_audit": filter_audit.SQL}
