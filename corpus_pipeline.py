"""A training-corpus pipeline: quality, toxicity, near-dedup, mixing, and token ids.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame,
which whoever runs the stages writes as Parquet and reads again for the next one. All but the last
return the columns of ``docs``. Labels come from the ``labels`` table beside the documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overlapkit.llm import _shared as S
from overlapkit.llm import mixing, quality, shingle_dedup, toxicity, unigram
from overlapkit.llm.queries import QUALITY_THRESHOLD

#: As in op6: of the held-out toxic documents more go (0.77 against 0.63 at 0.5), for a false-positive rate of 0.03 against 0.02.
TOXIC_THRESHOLD = 0.3

#: SQL cannot express the trained stages.
ORACLE_SQL = None


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier scores as good; null and empty texts are scored like any other."""
    model, score = quality.fit_quality(docs, _labels(spark, sf_dir)), S.free_name(docs, "score")
    return quality.score_quality(docs, model, score_col=score).where(F.col(score) >= QUALITY_THRESHOLD).drop(score)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; null and empty texts have no evidence and stay."""
    model, score = toxicity.fit_toxicity(docs, _labels(spark, sf_dir)), S.free_name(docs, "score")
    return toxicity.score_toxicity(docs, model, score_col=score).where(F.col(score) < TOXIC_THRESHOLD).drop(score)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard similarity of 5-word shingles 0.8 or more), that of
    the smallest id, null last; texts without words are copies of each other. Rows equal in all columns are one."""
    return shingle_dedup.keep_dissimilar(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their sources' target weights ask for; those without words go. Repeated rows are rows of
    their own; null ids and sources are kept; an empty table gives no rows."""
    return mixing.mixed_documents(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, token counts, ids, and whether the ids decode to the text; a row a row, null texts as empty ones."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    return unigram.encode_texts(docs, path, keep=["doc_id", "source"], digest=True)


STAGES = [
    ("quality", keep_quality),
    ("toxicity", keep_clean),
    ("near_dedup", keep_distinct),
    ("mixing", mix),
    ("pieces", to_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, S.materialize(stage(spark, docs, sf_dir))
        S.discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
