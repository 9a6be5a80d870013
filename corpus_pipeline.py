"""The training-data pipeline: five stages, each written as Parquet and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gazette.llm import decontaminate, line_dedup, near_copies, packing, quality, simhash
from gazette.llm.common import materialize, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the ranking rejects. It is learned from all labelled rows (the held-out third belongs to op4, which measures it)."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score(docs["text"], model) >= 0.5)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes cross-site boilerplate lines, however short, out of the texts; n_chars follows."""
    from pyspark.sql import functions as F

    out = line_dedup.remove_boilerplate(docs, min_words=1)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: by op7's link, then by a shingle Jaccard of 0.8 among those left."""
    return near_copies.keep_one(simhash.keep_one(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that leak a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences: a row for each piece."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("near dedup", near_deduplication),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: Learned scores, fingerprint components and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
