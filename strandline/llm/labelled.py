"""A bounded, reproducible sample of labelled documents for fitting small models on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import fold, map_texts
from strandline.llm.textstats import FEATURES, statistics

MAX_LABELLED = 20_000


def sampled_labels(labels: DataFrame, label: str = "quality", limit: int = MAX_LABELLED) -> DataFrame:
    """doc_id, label: at most ``limit`` ids outside fold 0, the first by a hash of the id; of several labels the smallest.

    A threshold on the hash, from a count, leaves about twice as many rows as are wanted; only those are put in order.
    """
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id")) != 0))
    one = rows.groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("label"))
    n, wanted = one.count(), 2 * limit + 100
    place = F.xxhash64("doc_id")
    few = one.filter(F.pmod(place, F.lit(1 << 40)) < int((1 << 40) * wanted / n)) if n > wanted else one
    return few.orderBy(F.pmod(place, F.lit(1 << 40)), "doc_id").limit(limit)


def training_sample(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features and 0/1 labels of at most ``limit`` labelled documents outside fold 0, one row for each id.

    Only the sampled ids are broadcast, ``limit`` rows at most. Rows with a null id or label are left out. Where an id
    has several texts, the one with the smallest features counts, so that repeated rows add nothing.
    """
    chosen = sampled_labels(labels, label, limit)
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    features = map_texts(texts, "features array<double>", lambda values: [[statistics(t)[1] for t in values]])
    found = features.groupBy("doc_id").agg(F.min(F.struct("label", "features")).alias("row")).select("row.*").toPandas()
    x = np.array(found["features"].tolist(), dtype=float).reshape(len(found), len(FEATURES))
    order = np.lexsort((*x.T, found["label"].to_numpy()))  # the order of arrival must not matter
    return x[order], found["label"].to_numpy(dtype=int)[order]
