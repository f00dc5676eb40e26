"""From raw documents to a training mix: five stages, each by one of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontam, jaccard, lines, mixing, quality
from quillon.llm.common import SPACES, materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that a quality rule rejects, null and empty texts too; an empty table stays empty."""
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that many sources share out of all but their first document; a document left without words goes.

    Texts of documents with a line removed and their n_chars change; all other
    columns, whatever their names, stay. A null text stays; an empty table stays empty.
    """
    out = lines.cleaned(docs)
    cut = F.col("n_removed") > 0
    out = out.filter(~cut | (F.length(F.translate("clean_text", SPACES, "")) > 0))
    new = {"text": F.col("clean_text"), "n_chars": F.when(cut, F.length("clean_text").cast("long")).otherwise(F.col("row.n_chars"))}
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by word 5-grams at a similarity of 0.8 or more, the one with the smallest key; of equal rows one. Texts without words all stay."""
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark. Null and empty texts and an empty benchmark match nothing."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources to their target weights: for each document, the words that the mix takes. A null text has none; a null source is a source."""
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
]

# SQL can't express the walks, samples and word edits of the decontamination stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
