"""The registered queries of this subpackage: each operator over its whole table, thin digests on top."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overlapkit.llm import _shared as S
from overlapkit.sources import scratch_dir
from overlapkit.llm import chat, embedding_dedup, media, mixing, nearest, periodic_runs, prefix_trie, quality, simhash, token_counts, token_files, toxicity, unigram

QUALITY_THRESHOLD = 0.5
TOXIC_THRESHOLD = 0.3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def learnable(df: DataFrame) -> DataFrame:
    """Rows whose labels may be learnt: crc32 of the id as text, mod 4, is not 2."""
    return df.where(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4, F.lit(0)) != 2)


def op1_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and decision of every document; learns from three folds of four."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.fit_quality(learnable(docs), learnable(labels))
    out = quality.score_quality(docs.select("doc_id", "text", "lang", "source", "n_chars"), model)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).alias("keep"))


def op2_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_components(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark)
    token_files.write_token_files(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_token_files(spark, path, ids=False)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "first_shard", "last_shard")


def op5_media_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = S.materialize(media.pack_media(_table(spark, sf_dir, "documents"), keep=["doc_id"]))
    out = media.probe_media(stored, keep=["doc_id", "n_bytes"], digests=True)
    ends = F.transform(F.array(F.element_at("keyframes", 1), F.element_at("keyframes", -1)), lambda k: F.concat_ws("+", k["offset"], k["size"]))
    feature = F.concat_ws(";", "codec", F.concat_ws("/", "duration", "timescale"), "n_samples", F.size("keyframes"), ends)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op6_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit_toxicity(learnable(docs), learnable(labels))
    out = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return out.select(
        "doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= TOXIC_THRESHOLD, 1).otherwise(0).alias("predicted")
    )


def op7_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op9_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return unigram.encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"], ids=False, digest=True)


def op10_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.render_perspectives(_table(spark, sf_dir, "conversations"))
    spans = F.concat_ws(",", F.transform("mask", lambda m: F.concat_ws("-", m["first"], m["last"])))
    return out.withColumn("mask", spans)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, one in ten of them with a tail made periodic, and digests of what is found."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    made = docs.withColumn("text", periodic_runs.repeat_tails(F.col("text"), F.col("doc_id")))
    out = periodic_runs.periodic_runs(made, keep=["doc_id"])
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("top"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("top.n")
    return out.select(
        "doc_id", "n_runs", F.col("top.start").alias("start"), length.alias("length"), F.col("top.period").alias("period"),
        F.expr("(-top.n * 1000) div top.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def op12_block_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every vector whose id is divisible by 100, among all vectors."""
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest.nearest(vectors.where(F.col("vec_id") % 100 == 0), vectors)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    own = prefix_trie.turn_sequences(_table(spark, sf_dir, "conversations"))
    return prefix_trie.trie_nodes(prefix_trie.graft_heads(own))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_quality_cotraining, op2_simhash_golay, op3_token_files, op4_mix_sources, op5_media_container,
        op6_toxicity_nnpu, op7_pivot_permutation, op8_token_counts, op9_unigram_pieces, op10_chat_perspectives,
        op11_periodic_runs, op12_block_neighbours, op13_prefix_trie,
    )
    return {f.__name__: f for f in found}
