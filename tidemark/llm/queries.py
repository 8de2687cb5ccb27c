"""The registered queries ``opN_<name>``: each binds one operator to its whole table, and gives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import chat, decontam, exact_dedup, media, mixing, periodic, prefix_trie, quality, secret_scan, simhash, substring, tokencount, warc
from tidemark.llm.shared import WORD


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


def op4_token_counts(spark: SparkSession, sf_dir: str, model: str = "piece_bpe_32k.model") -> DataFrame:
    import public_tokenizers

    return tokencount.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(model))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = [x.kind for x in (*secret_scan.PATTERNS, *secret_scan.ENTROPY)]
    counts = [secret_scan.count_kind("base", k).alias(f"n_{p.kind}") for k, p in enumerate(secret_scan.PATTERNS)]
    return found.select("doc_id", *counts, F.sha2(secret_scan.listed(F.col("base"), kinds), 256).alias("base_sha256"), secret_scan.listed(F.col("spans"), kinds).alias("spans"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    more = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(said).alias("prompt"), F.lit(said).alias("completion"))
    records = chat.gather(_table(spark, sf_dir, "conversations")).unionByName(more, allowMissingColumns=True)
    return chat.digests(chat.read_back(chat.render(chat.to_turns(records))))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    ranking = quality.fit(docs, _table(spark, sf_dir, "labels"))
    out = quality.score(docs, ranking, ["doc_id"])
    return out.select("doc_id", F.coalesce(quality.held_out("doc_id"), F.lit(True)).alias("held_out"), "score", "predicted")


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.without_repeats(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive(_table(spark, sf_dir, "pages"))
    number = lambda c: F.expr(f"try_cast({c} AS bigint)").alias(c)
    return found.select(number("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_table(spark, sf_dir, "documents"))


def with_periods(docs: DataFrame) -> DataFrame:
    """Every tenth document by its id's checksum repeats a stretch of itself from some word on."""
    h, (n, g) = F.crc32(F.col("doc_id").cast("string")), (F.col("n"), F.col("g"))
    chosen = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("words"))
    sized = chosen.withColumn("n", F.size("words")).withColumn("a", F.when(n > 0, (g % n).cast("int"))).withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    rest = n - F.col("a")
    period = F.slice("words", F.col("a") + 1, F.col("p"))
    again = F.slice(F.flatten(F.array_repeat(period, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    return sized.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), again), " ")).otherwise(F.col("text")).alias("text"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.collapse(with_periods(_table(spark, sf_dir, "documents")))
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    top = found.withColumn("top", longest)
    return top.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.expr("1000 * top.length div -top.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("kept", 256).alias("collapsed_sha256"),
    )


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): each conversation with the first turns of every fifth one in place of its own."""
    plain = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    own = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", plain("role"), plain("text"))
    own = own.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))).drop("turn")
    head = F.crc32(F.col("conv_id").cast("string")) % 9
    all_of = own.select("conv_id").distinct()
    lent = all_of.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("base")).join(own.withColumnRenamed("conv_id", "base"), "base").where(F.col("place") <= head)
    kept = own.where(F.col("place") > head)
    cols = ["conv_id", "side", "place", "role", "text"]
    return lent.withColumn("side", F.lit(0)).select(cols).unionByName(kept.withColumn("side", F.lit(1)).select(cols)), all_of


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, all_of = rebuilt(_table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(turns, ["side", "place"], all_of)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_mix, op3_decontam, op4_token_counts, op5_secrets, op6_chat, op7_quality, op8_substring, op9_warc, op10_media, op11_runs, op12_trie, op13_exact_dedup)}
