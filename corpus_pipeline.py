"""From raw documents to a training mix: five stages, each written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, mixing, near_copies, quality, secret_scan
from tidemark.llm.shared import new_folder, packed

# Operators see a document as one struct beside the columns that they read, so columns of any name pass unchanged.


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking, learned from the labelled ones among them, accepts."""
    ranking = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(packed(docs, "text"), ranking, ["doc"]).where("predicted = 1").select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: those whose sets of five-word runs have a similarity of 0.8 or more."""
    return near_copies.one_of_each(docs, width=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontam.contamination(packed(docs, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc"])
    return found.where(~F.col("contaminated")).select("doc.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret; ``n_chars``, where there is such a column, follows the text."""
    clean = secret_scan.redact(secret_scan.scan(packed(docs, "text")))
    text = F.col("text")
    new = {"text": text, "n_chars": F.when(F.size("spans") > 0, F.length(text).cast("long")).otherwise(F.col("doc.n_chars")) if "n_chars" in docs.columns else None}
    return clean.select(*[(new[c] if c in new else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with how often and how many words that makes: ``size, source_size, target, copies,
    taken``, with ``mix_`` before a name as often as the documents have it themselves."""
    mixed = mixing.mix(packed(docs, "doc_id", "source", "text"), keep=["doc"])
    have, added = {c.lower() for c in docs.columns}, []
    for c in ("size", "source_size", "target", "copies", "taken"):
        name = c
        while name in have:
            name = f"mix_{name}"
        have.add(name)
        added.append(F.col(c).alias(name))
    return mixed.where("copies > 0").select("doc.*", *added)


STAGES = [("quality", good_quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mask_secrets", mask_secrets), ("mix", mix_sources)]

#: The ranking and the near copies are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
