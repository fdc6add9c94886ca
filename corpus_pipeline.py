"""A corpus pipeline of five training-data operators; each stage is written and read again as the next one's documents.

A stage's result is lazy and must be written before the next stage is called, which deletes what the one before wrote for itself.

Defined cases, besides those of the operators: a document with a null or empty text, or without letters, has no language and goes in the
first stage; rows with a null doc_id are never near copies and stay through the second, and come after all others in the third; rows alike
in doc_id and text are one document, rows of one doc_id with different texts are several; a null source is a source of its own; an
empty table gives an empty one at each stage; further columns, whatever their names, are kept by all stages but the last.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroseries.llm import language_id, mixing, piece_lattice, simhash, substring_dedup
from hydroseries.llm.common import delete, new_table, remembered

#: What the last stage wrote for itself.
_left: list[str] = []


def _stage(stage):
    """A stage's result is written before the next one starts: only then what it wrote for itself is deleted, so the stages' tables do not add up."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _left:
            delete(spark, _left.pop())
        with remembered() as tables:
            made = stage(spark, docs, sf_dir)
        _left.extend(tables)
        return made

    return run


@_stage
def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found, mixed ones too; the model is learned from those that carry a label."""
    model = language_id.train(docs)
    whole = docs.select(F.struct("*").alias("document"), "text")  # columns named like the operator's own are not touched
    return language_id.label(whole, model).where(F.col("lang_pred") != language_id.UNKNOWN).select("document.*")


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return simhash.drop_near_copies(docs, similarity=0.8, shingle=5)


@_stage
def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has."""
    return substring_dedup.remove_repeats(docs)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in equal parts, by Poisson replication."""
    return mixing.poisson_mix(docs)[0].select(docs.columns)


@_stage
def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids and n_pieces of each document's best segmentation, and scores and changes of its N_BEST best."""
    made = piece_lattice.encode(docs.select("doc_id", "source", "text"), n=N_BEST)
    return made.select("doc_id", "source", "ids", F.size("ids").cast("bigint").alias("n_pieces"), "scores", "changes")


N_BEST = 4
STAGES = [
    ("language_id", keep_known_languages),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", remove_repeats),
    ("poisson_mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Fingerprint links and piece lattices can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_table(spark, name)
        made = stage(spark, docs, sf_dir)
        made.write.option("compression", "snappy").parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
