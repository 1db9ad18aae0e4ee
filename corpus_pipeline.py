"""From raw documents to training shards: the corpus operators one after the other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airloom.llm import records
from airloom.llm.leaks import without_leaks
from airloom.llm.mixing import mix_bloggers
from airloom.llm.near import near_copies
from airloom.llm.sharding import stratified_shards
from airloom.llm.simhash import one_of_each
from airloom.llm.votes import fit_votes, quality_votes
from airloom.session import shared_folder

SHARDS = 8
#: Documents keep their columns; the operators are told which of them they are for.
NAMES = {"content_id": "doc_id", "script": "text"}


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the votes of similar reviewed ones do not reject."""
    learned = records.fold_of(F.col("content_id"), 3) != 1
    known = records.as_scripts(docs).where(learned)
    model = fit_votes(known, records.reviews(spark, sf_dir).where(learned))
    return quality_votes(docs, model, **NAMES).where("vote >= 0.5").select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of smallest id."""
    return one_of_each(docs, **NAMES, components=near_copies)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text."""
    return without_leaks(docs, records.excerpts(spark, sf_dir), **NAMES)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture of sources takes it, 0 to 3 times."""
    mixed = mix_bloggers(docs, shards=SHARDS, blogger="source", **NAMES)
    copies = F.explode(F.sequence(F.lit(1), F.col("mix.copies")))
    return mixed.where("mix.copies > 0").select(*docs.columns, copies.alias("_copy")).drop("_copy")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row, a copy of a document being a row of its own.

    ``(doc_id, source, size, text_crc32, law, shard, slot)``; texts are not moved.
    """
    return stratified_shards(docs, SHARDS, blogger="source", **NAMES).select(
        F.col("content_id").alias("doc_id"),
        F.col("blogger").alias("source"),
        "size",
        F.col("script_crc32").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
    )


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", classify),
    ("simhash near-dedup", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix),
    ("sharding", shard),
]

#: Neither the votes nor XXH64 fingerprints can be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each result written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        folder = shared_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
