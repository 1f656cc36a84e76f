"""A training corpus from the documents table: five stages, each over all its predecessor kept.

Each stage takes all columns of documents, whatever their names and order, and all but the last return
them. An empty table passes through every stage. Texts of any length are read whole. Ids may be null;
rows that share an id are told apart by their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.llm import decontam, line_dedup, near_dups, queries, source_mix, toxicity
from tracequarry.llm.naming import unused
from tracequarry.session import staged


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain finds toxic go; a probability at the threshold counts as toxic.

    Null and empty texts have no features and stay. Repeated rows go or stay together. Without labels
    nothing goes.
    """
    chain = queries.toxicity_chain(docs, queries.table(spark, sf_dir, "labels"))
    (mark,) = unused(docs, "toxic")
    return toxicity.judge(docs, chain, out_col=mark).where(~F.col(mark)).drop(mark)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents share stay in the one with the largest id; documents stay, n_chars follows the text.

    A null text becomes the empty one. Repeated rows lose the same lines and count as one document.
    """
    kept = line_dedup.dedup_lines(docs, out_col="text", counts=False)
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def near_dups_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least id.

    Rows with one id and text stay once. Texts without words, null ones included, are no copies.
    """
    return near_dups.drop_near_duplicates(docs)


def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null texts and texts without words hold none. Without items nothing goes.
    """
    return decontam.drop_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes from each document, and its source's size and target.

    A null text has no words, a null source is a source of its own; ties in the seeded order fall back on
    the id. Without documents there are no rows.
    """
    return source_mix.mix_by_source(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dups", near_dups_stage),
    ("decontam", decontam_stage),
    ("source_mix", mix_stage),
]

#: The first stage fits a classifier, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
