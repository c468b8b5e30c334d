"""From raw documents to a training mix: toxicity, line dedup, near duplicates, benchmark leaks, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; stages write Parquet, and the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import decontam, lines, mixing, simhash, toxicity
from marginalia.session import cut_lineage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, quality) weights of the mix from the labels: 2 for good, 0.5 for poor."""
    labels = table(spark, sf_dir, "labels").where("quality is not null")
    return labels.select("doc_id", F.when(F.col("quality") == 1, 2.0).otherwise(0.5).alias("quality"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier calls toxic by the threshold of their language."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes boilerplate lines out of the texts; a document that consisted of nothing else goes."""
    out = lines.drop_boilerplate(docs).where("n_removed = 0 or btrim(text, ' \\t\\r\\n') <> ''")
    keep = [
        F.col("text") if c == "text" else F.length("text").cast("long").alias(c) if c == "n_chars" else F.col("row").getField(c).alias(c)
        for c in docs.columns
    ]
    return out.select(*keep)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group with 0.8 or more of its five-word shingles in common."""
    return simhash.near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item or a variant of one."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix with their words, their source's target and the words taken (epochs counted)."""
    mixed = mixing.mix(docs, quality(spark, sf_dir))
    return mixed.where("taken > 0").select(
        "doc_id", "source", "size", "source_size", "target", "taken", (F.col("taken") / F.col("size")).cast("int").alias("times")
    )


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: The classifier's scores are beyond SQL; tests hold the operators of the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
