"""A corpus pipeline over ``documents``: five stages, each one operator over all that its predecessor kept.

In every stage an empty table gives an empty one, texts are read whole whatever their length, and columns beyond those of
documents are left behind, whatever their names.  What each stage does with nulls, ties and repeated rows, its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from strandline.llm import langid, line_dedup, mixing, near_dedup, pieces
from strandline.sources.scratch import Scratch, released

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: A line goes if it is in more than this share of its source's documents, and in ``line_dedup.LEAST_PAGES`` at least.  Sources
#: are far wider than web hosts: lines that they repeat are in 1 to 10 % of their documents.
SOURCE_RATIO = 0.005


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with the length of the text as it is now."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled documents are in; texts without letters or far from every language go.

    A null text goes; a null id or label stays as it is.  Repeated rows fare alike; of languages at the same distance the first in order counts.
    """
    model = langid.fit(docs.where(langid.in_training(F.col("doc_id"))))
    told = langid.identify(docs, model, names=("_lang_pred", "_lang_score", "_lang_rejected"))
    return told.where(~F.col("_lang_rejected")).select(*COLUMNS)


def line_frequency(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that their source repeats.

    Null texts and documents of a null source stay as they are.  A repeated row is a document of its own; a line at exactly the ratio stays.
    """
    return _documents(line_dedup.drop_boilerplate(docs, "source", "text", ratio=SOURCE_RATIO, name="stage2"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least id; rows that repeat an id count as one document.

    Null and wordless texts and rows without an id are like nothing else and stay.
    """
    classes = near_dedup.near_duplicates(docs, percent=80, name="stage3")
    scratch = Scratch(spark, "stage3rows")
    gone = scratch.save(classes.where("not kept").select("doc_id").distinct())
    again = scratch.save(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id"))
    left = docs.join(gone, "doc_id", "left_anti")
    one = left.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("r")).select("doc_id", "r.*")
    return left.join(again, "doc_id", "left_anti").select(*COLUMNS).union(one.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mix of sources takes them.

    A null source is one more source, the last; null and wordless texts are never taken.  A repeated row is a document of its own.
    """
    return _documents(mixing.mixed_documents(docs, name="stage4"))


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, null for a null one; repeated rows get the same ids, and of equal paths the one with the longest last piece counts."""
    coded = pieces.encode(docs.select("doc_id", "lang", "source", "text"), name="stage5")
    return coded.select("doc_id", "lang", "source", F.coalesce(F.size("tokens"), F.lit(0)).cast("long").alias("n_tokens"), "tokens")


STAGES = [
    ("language id", language_id),
    ("line dedup", line_frequency),
    ("near-dedup", near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", sentencepiece_ids),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each result written and read again as the next one's input."""
    scratch = Scratch(spark, "pipeline")
    first = docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with released():
            new = scratch.save(stage(spark, docs, sf_dir))
        if docs is not first:
            scratch.drop(docs)
        docs = new
    return STAGES[-1][1](spark, docs, sf_dir)
