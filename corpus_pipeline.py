"""From raw documents to packed training sequences, in five stages over tables.

Each stage takes all that the one before kept and returns the columns of
``documents``; the last returns the pieces of packed sequences. ``run`` writes
every stage's result to the shared folder and reads it back, so a lost executor
repeats work of one stage only; a stage's own scratch tables go when its result
is written.

Edge cases are those of the operators: null and empty texts fail the quality
rules; rows with equal ids are judged each on their own by the first three
stages and are one document in the near-duplicate stage; an empty table passes
through all stages; a document that line dedup leaves without a word, as all its
lines stand in earlier ones, goes there. Columns beside those of ``documents`` are carried through
the first four stages, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm import linededup, neardup, packing, quality_model, quality_rules, vocab
from granary.llm.common import released, save, scratch_path, table


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return quality_rules.kept_documents(docs)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It learns from the labelled documents of the whole table, as it must see rejected ones too."""
    return quality_model.good_documents(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the lines of repeated three-line windows; ``n_chars`` follows the text. Documents of which no word is left say nothing new and go."""
    return linededup.clean_documents(docs, drop_emptied=True)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id."""
    return neardup.unique_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack_documents(docs, vocab.path(vocab.WORD_BPE))


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("packing", packing_stage),
]

#: Training the classifier can't be said in SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        with released(spark):
            docs = save(stage(spark, docs, sf_dir), path)
    return docs
