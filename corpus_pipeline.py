"""Documents to training sequences: filter, deduplicate, mix, pack."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, packing, simhash, substring, toxicity
from tidemark.llm.common import clear, mark, materialise, remove, scratch_path, small_batches, table

# A worker of one stage stays for the next ones, beside what Spark itself holds by then: less than packing alone would take.
CACHED_WORDS, CHUNK_BYTES = 200_000, 2_000_000


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; labels teach the classifier, and are not looked up."""
    small_batches(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, "__toxic").where("__toxic < 0.5").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of SimHash fingerprints, linked as in op9_simhash; of these, one of each group that is alike by exact shingle sets."""
    small_batches(spark)
    apart = materialise(simhash.drop_near_duplicates(docs, shingle=3, seed=42, distance=2), "simhash")
    return simhash.drop_near_copies(apart, shingle=5, similarity=0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of earlier documents; documents that have nothing else go."""
    small_batches(spark)
    kept = substring.remove_repeats(docs).where("n_removed = 0 or n_removed < n_words")
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As even as reading no source more than twice allows, the largest once: all documents stay."""
    mixed = mixing.mix(docs, mixing.token_count(F.col("text")), max_epochs=2.0, tie_by=["doc_id"])
    return mixed.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all reads: doc_id, read (from 0; of a document that is read several times) and piece are their key.

    Groups of pieces are drawn at random, so every run of sequences holds the sources at the weights of the mixing.
    """
    small_batches(spark)
    pieces = packing.tokenise(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False, cached_words=CACHED_WORDS, chunk_bytes=CHUNK_BYTES)
    return packing.pack(packing.numbered_reads(pieces))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("simhash", drop_near_copies),
    ("substring", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# Hashes, a trained model and a tokenizer decide the rows: SQL can't express them. Tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written and read again as the next one's input, and go when that one's are there."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        before = mark()
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        clear(spark, before)
        if last:
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
