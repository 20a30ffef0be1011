"""A training corpus from raw documents in five stages, each an operator over all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontamination, labelled, mixture, quality_ranking, secrets, simhash
from strandline.llm.common import discard, settle, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the quality classifier predicts to be good. The ranking is fitted on ``docs``' labelled rows."""
    ranking = quality_ranking.fit(*labelled.training_sample(docs, table(spark, sf_dir, "labels")))
    return quality_ranking.keep_good(docs, ranking)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of exact and near copies."""
    return simhash.drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    return decontamination.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask every reported secret in the text; all documents stay, and n_chars follows the text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order with what the mix takes of them; those it takes nothing of are left out."""
    keep = tuple(c for c in ("text", "lang", "source", "n_chars") if c in docs.columns)
    mixed = mixture.mix_sources(docs, keep=keep)
    return mixture.in_training_order(mixed.filter("taken > 0"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", decontaminate),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix),
]

#: Learnt scores, hashes of shingles and BM25 scores are beyond SQL. The tests hold the first two stages against brute force
#: and look for what the others must leave; each stage's operator has tests of its own.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; every stage but the last is written and read again, and its own tables are deleted."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES[:-1]:
        docs = settle(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
