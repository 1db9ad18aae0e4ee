"""Registered queries: the driver's tables through the operators, and back to driver columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.llm import records
from airloom.llm.alignment import aligned_scripts, link_counts, link_strengths, token_groups
from airloom.llm.archives import page_of, read_archives, write_archives
from airloom.llm.languages import fit_languages, script_languages
from airloom.llm.leaks import leaked_excerpts
from airloom.llm.licences import licence_scan
from airloom.llm.loops import script_loops
from airloom.llm.mixing import mix_bloggers
from airloom.llm.paragraphs import repeated_paragraphs
from airloom.llm.passages import repeated_passages
from airloom.llm.quality import quality_rules
from airloom.llm.related import related_by_features
from airloom.llm.sharding import stratified_shards
from airloom.llm.simhash import as_hex, near_duplicates
from airloom.llm.votes import fit_votes, quality_votes
from airloom.session import shared_folder
from airloom.sources import load_table

TOKENIZERS = "/opt/tokenizers"

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(records.scripts(spark, folder)).select(
        F.col("content_id").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def op2_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(records.scripts(spark, folder)).select(
        F.col("content_id").alias("doc_id"),
        as_hex(F.col("fingerprint")).alias("fingerprint"),
        "component_id",
    )


def op3_stratified_shards(spark: SparkSession, folder: str) -> DataFrame:
    return stratified_shards(records.scripts(spark, folder), 8).select(
        F.col("content_id").alias("doc_id"),
        "size",
        F.col("script_crc32").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = leaked_excerpts(records.scripts(spark, folder), records.excerpts(spark, folder))
    return found.select(
        F.col("content_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("source_ids").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "source_ids"), 256).alias("items_sha256"),
        F.col("leaked").alias("contaminated"),
    )


def op5_warc_salvage(spark: SparkSession, folder: str) -> DataFrame:
    archives = shared_folder(spark, "archives")
    write_archives(load_table(spark, folder, "pages"), archives)
    return (
        read_archives(spark, archives)
        .where("gap IS NULL")
        .select(
            page_of(F.col("record_id")).alias("page_id"),
            "payload_bytes",
            "payload_digest",
            "record_type",
            page_of(F.col("refers_to")).alias("refers_to"),
        )
    )


def op6_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licence_scan(records.scripts(spark, folder)).select(
        F.col("content_id").alias("doc_id"),
        F.concat_ws(",", "sentences").alias("sentences"),
        F.concat_ws(",", "licences").alias("licences"),
    )


def op7_repeated_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    content = records.scripts(spark, folder)
    lines = repeated_paragraphs(content).withColumn("part", F.lit("line"))
    passages = repeated_passages(content).drop("length").withColumn("part", F.lit("passage"))
    return lines.unionByName(passages).select(
        F.col("content_id").alias("doc_id"),
        "paragraph",
        "start",
        "n_words",
        F.col("class_content_id").alias("class_doc_id"),
        "class_paragraph",
        "n_paragraphs",
        "removed",
        "part",
    )


def op8_language_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """A document without an id is in no fold: it is neither learned from nor held out."""
    content = records.scripts(spark, folder)
    held_out = records.fold_of(F.col("content_id"), 4) == 2
    model = fit_languages(content.where(~held_out))
    return script_languages(content, model).select(
        F.col("content_id").alias("doc_id"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.col("language").alias("lang_pred"),
        F.col("share").alias("score"),
        F.concat_ws(",", "languages").alias("langs"),
    )


def op9_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mix_bloggers(records.scripts(spark, folder)).select(
        F.col("content_id").alias("doc_id"),
        "mix.size",
        "mix.source_size",
        "mix.target",
        "mix.taken",
    )


def op10_quality_votes(spark: SparkSession, folder: str) -> DataFrame:
    """A document without an id is in no fold: it is neither learned from nor held out."""
    content = records.scripts(spark, folder)
    learned = records.fold_of(F.col("content_id"), 3) != 1
    model = fit_votes(content.where(learned), records.reviews(spark, folder).where(learned))
    return quality_votes(content.select("content_id", "script"), model).select(
        F.col("content_id").alias("doc_id"),
        F.coalesce(~learned, F.lit(False)).alias("held_out"),
        F.col("vote").alias("score"),
        (F.col("vote") >= 0.5).cast("int").alias("predicted"),
    )


def op11_related_by_features(spark: SparkSession, folder: str) -> DataFrame:
    items = records.featured(spark, folder)
    return related_by_features(items, F.col("item_id") % 20 == 0, 20).select(
        F.col("item_id").alias("query_id"), "rank", F.col("related_item_id").alias("vec_id"), "score"
    )


def op12_script_loops(spark: SparkSession, folder: str) -> DataFrame:
    loops = script_loops(records.looped(records.scripts(spark, folder)))
    listed = F.transform("loops", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    return loops.select(
        F.col("content_id").alias("doc_id"),
        F.size("loops").cast("bigint").alias("n_runs"),
        "strongest.start",
        "strongest.length",
        "strongest.period",
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_token_alignment(
    spark: SparkSession, folder: str, tokenizers: str = TOKENIZERS
) -> DataFrame:
    aligned = aligned_scripts(
        records.scripts(spark, folder),
        f"{tokenizers}/byte_bpe_50k.json",
        f"{tokenizers}/piece_bpe_32k.model",
    )
    strengths = link_strengths(aligned, link_counts(aligned))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    groups = token_groups(aligned).withColumn("groups_sha256", digest).drop("groups")
    return groups.join(strengths, "row").select(
        F.col("content_id").alias("doc_id"),
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        "n_best",
        "count_sum",
        "groups_sha256",
    )


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_simhash_groups": op2_simhash_groups,
    "op3_stratified_shards": op3_stratified_shards,
    "op4_decontamination": op4_decontamination,
    "op5_warc_salvage": op5_warc_salvage,
    "op6_licence_scan": op6_licence_scan,
    "op7_repeated_paragraphs": op7_repeated_paragraphs,
    "op8_language_mixture": op8_language_mixture,
    "op9_mix_sources": op9_mix_sources,
    "op10_quality_votes": op10_quality_votes,
    "op11_related_by_features": op11_related_by_features,
    "op12_script_loops": op12_script_loops,
    "op13_token_alignment": op13_token_alignment,
}
