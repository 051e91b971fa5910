"""The queries of this subpackage over whole tables, and their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeworks.llm import (chat, decontamination, divergence, filter_audit, html_text, line_dedup, ngram_join, packing, quality_rules, sharding,
                            suffix_dedup, token_counts, twins, warc)
from gradeworks.session import shared_dir, write_table


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def op1_warc(spark: SparkSession, sf: str) -> DataFrame:
    """All pages written to archives and read back through the index."""
    folder = _folder(spark, "warc")
    pages = _table(spark, sf, "pages")
    index = warc.write_archives(pages, folder)
    back = warc.read_records(index, folder, payloads=False)
    kind = pages.schema["page_id"].dataType
    return back.select(F.col("key").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       F.col("refers_to").cast(kind).alias("refers_to"))


def op3_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    """Maximal conversations, rendered."""
    return chat.format_chats(_table(spark, sf, "conversations"))


def op4_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Totals after loading all documents (delivered twice), deleting exact copies and counting a closing
    id in every remaining document."""
    counts = write_table(token_counts.count_tokens(_table(spark, sf, "documents")), "token-counts")
    rollup = token_counts.TokenRollup(spark, _folder(spark, "rollup"))
    copies = write_table(token_counts.copies(counts), "token-copies")
    rollup.commit("load", token_counts.inserted(counts))
    rollup.commit("load", token_counts.inserted(counts))
    rollup.commit("copies", token_counts.deleted(copies))
    longer = token_counts.inserted(counts).withColumn("old_tokens", F.col("new_tokens")).withColumn(
        "new_tokens", F.col("new_tokens") + 1)
    taken_back = token_counts.deleted(copies).withColumn("new_tokens", F.col("old_tokens")).withColumn(
        "old_tokens", F.col("old_tokens") + 1)
    rollup.commit("closing", longer.unionByName(taken_back))
    return rollup.totals()


def op2_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Measures and verdict of every document."""
    return quality_rules.judge(_table(spark, sf, "documents"))


def op5_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes, equal texts together."""
    placed = sharding.shard(_table(spark, sf, "documents"))
    return placed.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op6_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    """Components of documents whose 3-word shingles have a Jaccard coefficient of 0.9 or more."""
    return ngram_join.join_components(_table(spark, sf, "documents"))


def op7_packing(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packing.pack(_table(spark, sf, "documents"))


def op8_suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """What remains of every document without 50-byte strings that start in an earlier one."""
    done = suffix_dedup.remove_repeats(_table(spark, sf, "documents"), suffix_dedup.sha256)
    return done.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))


def op9_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold benchmark items, with scores and overlaps."""
    return decontamination.find_leaks(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def op10_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(_table(spark, sf, "pages"))


def op11_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every document without the long lines that stand in five documents or more."""
    done = line_dedup.drop_lines(_table(spark, sf, "documents"), suffix_dedup.sha256)
    return done.select("row.doc_id", "n_lines", "n_dropped", F.col("kept").alias("kept_sha256"))


def op12_source_divergence(spark: SparkSession, sf: str) -> DataFrame:
    """How far the sources of each language are from each other, and the terms that mark each."""
    return divergence.audit(_table(spark, sf, "documents"))


def op13_filter_interaction(spark: SparkSession, sf: str) -> DataFrame:
    """What five filters remove in every order."""
    return filter_audit.audit(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_quality_rules": op2_quality_rules,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_token_counts": op4_token_counts,
    "op5_sharding": op5_sharding,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_packing": op7_packing,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_html_extraction": op10_html_extraction,
    "op11_line_dedup": op11_line_dedup,
    "op12_source_divergence": op12_source_divergence,
    "op13_filter_interaction": op13_filter_interaction,
}

TWINS = {
    "op1_warc": twins.OP1,
    "op2_quality_rules": twins.OP2,
    "op3_chat_formatting": twins.OP3,
    "op11_line_dedup": twins.OP11,
    "op12_source_divergence": twins.OP12,
    "op13_filter_interaction": twins.OP13,
}
