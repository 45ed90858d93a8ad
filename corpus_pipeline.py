"""The corpus pipeline: toxic documents go, then copies, then near copies; sources are mixed and the result is encoded.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. run() writes what each
returns as Parquet to the shared folder and reads it again as the next one's docs. All but the last return the columns of
documents. An empty table passes through as an empty table.

A stage's result is to be written before the next stage of the same thread begins, as run() does: the tables that it was
made from, in the shared folder, go when the next stage begins. Pipelines of several threads don't touch each other's.

Defined results, by the operators': null texts count as empty (toxicity keeps them as clean; they are copies of each other
and of empty texts, so one stays; the n-gram join links them with nothing; they have no tokens); texts of any length pass
whole; of equal texts the largest doc_id stays, of near copies the smallest; rows that repeat an id are rows of their own;
null ids are kept; columns of other names, also ones that the operators add themselves, pass through all but the last stage.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from waymark.llm.common import drop, free_name, made_since, mark, read, release, stored
from waymark.llm.queries import tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, fitted to the training labels, does not reject."""
    model = toxicity.fit(docs, toxicity.training_labels(read(spark, sf_dir, "labels")))
    predicted = free_name(docs.columns, "predicted")
    return toxicity.score(docs, model).where(F.col(predicted) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of equal texts."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.75."""
    return ngram_join.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight draws them, in random order."""
    return mixing.mix(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the digest of what they decode to."""
    made = bpe.encode_checked(docs.select("doc_id", "source", "text"), tokenizer_file())
    return made.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


class _Spent(threading.local):
    """Tables behind the last stage's result, by thread."""

    def __init__(self):
        self.paths: list[str] = []


_spent = _Spent()


def _tidy(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, after the tables behind the last stage's written result are gone."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _spent.paths)
        begin = mark()
        result = stage(spark, docs, sf_dir)
        _spent.paths = made_since(begin)
        return result

    return run_stage


STAGES = [
    ("toxicity", _tidy(drop_toxic)),
    ("exact_dedup", _tidy(drop_copies)),
    ("ngram_join", _tidy(drop_near_copies)),
    ("source_mixing", _tidy(mix_sources)),
    ("bpe", _tidy(encode_texts)),
]
#: Stages 1, 3 and 5 are nothing that SQL can express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if k:
            drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
