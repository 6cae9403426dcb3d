"""A corpus from documents to packed training sequences, in five stages.

Every stage reads what its predecessor wrote and passes on the columns of `documents`,
but for the last, which returns one row per piece of a packed document.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.llm import language, lines, near, packing, toxicity
from patronage.llm.common import fresh, read, small_batches, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; out go null texts, texts without a letter, and texts
    with less evidence for their language than all but 0.5 % of held-out labelled texts of it.

    Learns from the documents' own `lang`. Where no document has one, nothing can be told
    apart, and only null texts and texts without a letter go.
    """
    model = language.train(docs, reject=True)
    if not model.families:
        return docs.where(F.col("text").cast("string").rlike("\\p{L}"))
    found, score = fresh(docs, "lang_found"), fresh(docs, "lang_score")
    told = language.identify(docs, model, found, score)
    return told.where(F.col(found) != language.UNKNOWN).select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under the toxicity threshold by a model of the documents with a label."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    score = fresh(docs, "toxic_score")
    return toxicity.score(docs, model, score).where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that equal or nearly equal an earlier one; `n_chars`, if there, follows the text."""
    done = lines.deduplicate_lines(docs, shortest=1)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        done = done.withColumn("n_chars", F.length("text").cast(kind))
    return done.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies (0.8 of the five-word shingles): the one with the least id."""
    return near.deduplicate(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most 2048 tokens."""
    return packing.pack(docs, TOKENIZER, remember=150_000)


def bounded(stage: Stage) -> Stage:
    """`stage` with documents sent to Python in small batches: at 10,000 rows each, a batch is held several times over."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES: list[tuple[str, Stage]] = [
    ("language_id", bounded(language_id)),
    ("toxicity", bounded(toxic)),
    ("line_dedup", bounded(line_dedup)),
    ("simhash_near_dedup", bounded(near_dedup)),
    ("best_fit_packing", bounded(pack)),
]

# Learned models, edit distance and token ids are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
