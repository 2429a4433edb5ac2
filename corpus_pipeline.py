"""The corpus pipeline: quality, near duplicates, secrets, mix, packing, each stage on all that the one before it kept.

Every stage takes null and empty texts, null and repeated doc_ids, equal rows, empty tables and further columns, which go
through unchanged, whatever their names; what it makes of them stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataweave.llm import mixing, near_dedup, packing, quality, secrets
from strataweave.llm.store import drop, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled rows of the table itself, doesn't reject.

    A null text is scored as an empty one."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates; five words, similarity 0.8 or more.

    Of rows that repeat a doc_id, all or none stay, as their texts' groups have it; rows with a null doc_id stay."""
    found = near_dedup.near_duplicates(docs, percent=80)
    dropped = found.filter("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets replaced by a mark, and n_chars brought up to date.

    A null or empty text stays as it is; each of the rows that share a doc_id, or have none, is scanned by itself."""
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, or their parts, that the mix draws, each as often as it is drawn.

    A null or blank text has no words and is never drawn; rows that share a doc_id, or have none, are drawn each by itself."""
    return mixing.drawn(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed sequences with their ids.

    A null or empty text is its end mark alone; rows that share a doc_id, or have none, are packed each by itself."""
    return packing.pack(docs, packing.vocabulary())


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("secret scans", secrets_stage),
    ("mixing sources", mixing_stage),
    ("packing", packing_stage),
]

#: The classifier, the mix and the tokenizer have no form in SQL; each stage is tested against a plain version of itself.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table of documents; each one's result is written and read again, as its rows feed several jobs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)



