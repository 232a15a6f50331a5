"""The queries of this subpackage: each applies its operator to a whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, divergence, graph_dedup, langid, line_dedup, mixing, nearest, pieces, pii, quality, toxicity, warc
from .near_dedup import near_duplicates
from .scratch import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learnt from the rows that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    trained = langid.in_training(F.col("doc_id"))
    model = langid.fit(docs.where(trained))
    return langid.identify(docs.select("doc_id", (~trained).alias("held_out"), "text"), model).drop("text")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as text, less the lines that their host repeats."""
    return line_dedup.drop_boilerplate(line_dedup.page_lines(_table(spark, sf_dir, "pages")), "host", "text", name="op2")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents at a similarity of 0.85."""
    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85, name="op3")


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisits among the captures of all pages, resolved to the latest earlier response."""
    found = warc.resolve_revisits(warc.captures(_table(spark, sf_dir, "pages")), name="op4")
    return found.withColumn("headers", warc.header_text(F.col("headers"))).drop("url")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels that are not held out."""
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    trained = langid.in_training(F.col("doc_id"))
    model = toxicity.fit(docs.where(trained), labels.where(trained))
    scored = toxicity.score(docs.select("doc_id", (~trained).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), F.size("offending").cast("long").alias("n_offending"), F.col("offending.sentence").alias("offending"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text of the documents, as counts and digests."""
    return pii.digest(pii.find_pii(_table(spark, sf_dir, "documents")))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all vectors at a cosine of 0.95."""
    return graph_dedup.near_vectors(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), name="op7", whole=True)


def op8_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors with the largest inner product for every twentieth one."""
    vecs = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest.nearest(vecs, vecs.where("vec_id % 20 = 0"), name="op8")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all documents takes of each."""
    return mixing.taken_words(mixing.mix(_table(spark, sf_dir, "documents"), name="op9")).withColumnRenamed("id", "doc_id")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document's text, and whether they decode to exactly that text."""
    coded = pieces.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), name="op10", verify="round_trip")
    return coded.select("doc_id", F.coalesce(F.size("tokens"), F.lit(0)).cast("long").alias("n_tokens"), "tokens", "round_trip")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document, and whether the base and the rules learnt from the labels that are not held out keep it."""
    stats = Scratch(spark, "op11").save(quality.statistics(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    rules = quality.fit(stats.where(langid.in_training(F.col("doc_id"))), _table(spark, sf_dir, "labels"), name="op11")
    shown = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"]
    return quality.judge(stats, rules).select(*shown)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the terms of each source are from the other sources of its language, and which terms stand out."""
    return divergence.audit(_table(spark, sf_dir, "documents"), name="op12")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by a fixed rule and repaired by the cheapest edits."""
    table = _table(spark, sf_dir, "conversations")
    return conversations.report(table.select("conv_id").distinct(), conversations.repair(conversations.damaged(table), name="op13"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_line_dedup, op3_minhash_near_dedup, op4_warc_revisits, op5_toxicity, op6_pii, op7_embedding_near_dedup, op8_cross_polytope, op9_mixing, op10_sentencepiece, op11_quality_rules, op12_source_divergence, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": line_dedup.ORACLE, "op4_warc_revisits": warc.ORACLE, "op12_source_divergence": divergence.ORACLE, "op13_conversation_repair": conversations.ORACLE}
