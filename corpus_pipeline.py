"""From raw documents to packed training sequences, in stages that can be run and resumed one by one.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each as Parquet and hands the reread
table to the next. All stages but the last return the columns of ``documents``; the last one's rows carry their token ids.
Without a folder, ``run`` writes below the shared scratch folder. With one, a stage that is finished there (its write
was committed) is not run again, so a run that was cut off goes on where it stopped.
Packing needs a tokenizer and near-duplicate groups need iteration, so SQL can't express the whole (ORACLE_SQL is None);
tests/llm hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlens.llm import langid
from adlens.llm.common import finished, materialize, table
from adlens.llm.decontaminate import remove_contaminated
from adlens.llm.packing import pack
from adlens.llm.queries import vocabulary
from adlens.llm.simhash import simhash_dedup
from adlens.llm.substring_dedup import remove_repeats


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or without a language that the model accepts."""
    return langid.keep_identified(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each SimHash group."""
    return simhash_dedup(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out words of windows that occur at two places; n_chars follows the text."""
    cut = remove_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"), whole_documents=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every piece of every document, with its token ids, in a sequence of at most 4096 tokens."""
    return pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontaminated", decontaminated),
    ("packed", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over ``documents``; ``folder``: a shared folder of this run's own, to resume in."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        if folder is None:
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            continue
        path = f"{folder.rstrip('/')}/{i}-{name}"
        if not finished(spark, path):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
