"""A corpus pipeline of training-data operators: STAGES, one after another over documents.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept;
its result is written as Parquet and read again as the next one's docs. All stages but
the last return the columns of documents.

Edges, for every stage: an empty table gives an empty one; columns beyond those of
documents stay as they are, but for names that a stage's docstring mentions; repeated rows
are rows of their own until near duplicates go; very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from penlight.llm import bpe, mixing, ngram_join, pii, quality_crf
from penlight.llm._shared import held_out, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field predicts good; it learns from the labels outside the held-out quarter.

    A null or empty text is judged as one empty line; equal texts are judged alike; without
    labels of both kinds all documents stay if 0.7 or more of the labels are 1, else none.
    Columns score and predicted come back with the field's values.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    field = quality_crf.learn(docs, labels)
    return quality_crf.scored(docs, field).where("predicted = 1").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest id, of every group linked by shared word 5-grams.

    Texts without words (null, empty, blank) are linked with nothing and stay, each one; of
    several rows of one id one stays, rows with a null id all do.
    """
    return ngram_join.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind. A null text stays null; of spans that overlap the first stands for both."""
    return pii.masked(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them.

    A null source is a source of its own, the last one; texts without words have size 0
    and come as often as their source is repeated as a whole, not at all if it has no words.
    """
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens and digests of ids and decoded text, a row for each repetition; a null text counts as empty."""
    # The stages before leave executors large, so tasks remember fewer words than alone.
    return bpe.digests(docs, remembered=bpe.FEW)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", mixture),
    ("BPE encoding and decoding", tokens),
]

#: The first, second and last stage are a model, an iterative join and a codec: no SQL. tests/llm holds the whole against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{at}")
    return docs
