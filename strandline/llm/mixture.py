"""Mixing sources to target weights by a curriculum that changes over training.

Every source has a weight schedule over training time t in [0, 1], a line from a start to an end weight. Its integral
up to t, scaled to the source's target, is the cumulative demand for its words. A document occupies an interval of that
demand; inverting the demand at the interval's middle gives the document's training position, and sorting all documents
by position gives the training order. A source that is wanted more than once over is read in several passes.

All of it is DataFrame code. Documents of one source follow a hash of id and text, which is cut into small buckets;
sizes are summed per bucket, per group of buckets and per group of groups, and running totals are taken level by level,
so that a source with a third of all rows is spread over many tasks and no task holds more than a group's rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import word_count

WEIGHTS = (5, 2, 1)
#: Start and end weight of each source's schedule, repeating along the sources like the weights.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
MAX_REPEATS = 3
#: Documents of all sources in a bucket, on average, and the children of a group at the levels above.
BUCKET_DOCS = 64
FAN_OUT = 1024


def _cycle(values: tuple, rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.pmod(rank - 1, F.lit(len(values))).cast("int") + 1)


def invert_demand(share: Column, start: Column, end: Column) -> Column:
    """Time at which a schedule running linearly from ``start`` to ``end`` has met ``share`` of its whole demand."""
    mean = (start + end) / 2
    slope = end - start
    root = F.sqrt(F.greatest(start * start + 2 * slope * mean * share, F.lit(0.0)))
    return F.when(F.abs(slope) < 1e-12, share).otherwise((root - start) / F.when(slope == 0, 1.0).otherwise(slope))


def source_targets(buckets: DataFrame, weights: tuple = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Per source its target: a share of all words by weight, at most ``max_repeats`` times its own words.

    The excess of capped sources goes to the others by weight until none is above its cap. With sources ordered by
    cap per weight, the common level is the largest of (words left after the caps before) / (weights left).
    """
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy("no_source", "source_key")
    by_level = Window.orderBy("cap_per_weight", "source_rank")
    sources = buckets.groupBy("no_source", "source_key").agg(F.sum("bucket_size").alias("source_size"))
    return (
        sources.withColumn("source_rank", F.row_number().over(by_name))
        .withColumn("weight", _cycle(weights, F.col("source_rank")))
        .withColumn("cap", F.col("source_size") * max_repeats)
        .withColumn("cap_per_weight", F.col("cap").cast("double") / F.col("weight").cast("double"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weights_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("level", F.max((F.col("total") - F.col("caps_before")).cast("double") / F.col("weights_left").cast("double")).over(everything))
        .withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight").cast("double")))
        .select("no_source", "source_key", "source_size", "source_rank", "target")
    )


def _offsets(buckets: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """``buckets`` (no_source, source_key, bucket, bucket_size) with bucket_offset: the sizes before it in its source.

    Two levels of groups stand above the buckets, so a window holds ``fan_out`` rows, and the last one as many as
    there are groups of groups.
    """
    source = ["no_source", "source_key"]
    levels = [buckets.withColumnsRenamed({"bucket": "g0", "bucket_size": "s0"}).withColumns({"g1": F.floor(F.col("g0") / fan_out), "g2": F.floor(F.col("g0") / fan_out**2)})]
    levels.append(levels[0].groupBy(*source, "g1", "g2").agg(F.sum("s0").alias("s1")))
    levels.append(levels[1].groupBy(*source, "g2").agg(F.sum("s1").alias("s2")))
    before = lambda k, inside: F.coalesce(F.sum(f"s{k}").over(Window.partitionBy(*source, *inside).orderBy(f"g{k}").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    low, middle, top = (levels[k].withColumn(f"o{k}", before(k, inside)) for k, inside in ((0, ["g1"]), (1, ["g2"]), (2, [])))
    joined = low.join(middle.select(*source, "g1", "o1"), [*source, "g1"]).join(top.select(*source, "g2", "o2"), [*source, "g2"])
    return joined.select(*source, F.col("g0").alias("bucket"), (F.col("o0") + F.col("o1") + F.col("o2")).alias("bucket_offset"))


def mix_sources(
    docs: DataFrame,
    weights: tuple = WEIGHTS,
    schedules: tuple = SCHEDULES,
    max_repeats: int = MAX_REPEATS,
    bucket_docs: int = BUCKET_DOCS,
    keep: tuple = (),
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, passes, position, occurrences.

    Sources are ordered by code point, null last; ``weights`` and ``schedules`` repeat along them. Within a source
    documents follow a hash of their id and text; each full pass takes all of them, and the last pass stops at the
    demand's end, in the middle of a document if need be. ``occurrences`` has a struct (pass, words, position) for every
    time the document is read. Null text has size 0 and is taken 0 times; position is then null. Repeated rows are mixed
    like different documents; equal rows get equal hashes and may swap places. Rows with a null or shared id are dealt
    by their texts. An empty table gives no rows. ``keep`` names further columns of ``docs`` to carry along; others are
    ignored, whatever their names.
    """
    name = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    sized = docs.select(
        "doc_id",
        *[F.col(c).alias(f"kept_{c}") for c in keep],
        F.col("source").isNull().alias("no_source"),
        F.coalesce("source", F.lit("")).alias("source_key"),
        word_count(F.col("text")).alias("size"),
        F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long").alias("mix_hash"),
    )
    n_buckets = max(1, math.ceil(docs.count() / bucket_docs))
    sized = sized.withColumn("bucket", F.floor(F.col("mix_hash") / math.ceil(16**15 / n_buckets)))
    place = ["no_source", "source_key", "bucket"]
    buckets = sized.groupBy(*place).agg(F.sum("size").alias("bucket_size"))
    plan = _offsets(buckets).join(source_targets(buckets, weights, max_repeats), ["no_source", "source_key"])
    inside = Window.partitionBy(*place).orderBy("mix_hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        sized.join(plan, place)
        .withColumn("offset", F.col("bucket_offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size").cast("double"))).otherwise(0).cast("long"))
        .withColumn("rest", F.floor(F.col("target") + 0.5).cast("long") - F.col("full") * F.col("source_size"))
        .withColumn("last_words", F.least(F.greatest(F.col("rest") - F.col("offset"), F.lit(0)), F.col("size")))
        .withColumn("taken", F.col("full") * F.col("size") + F.col("last_words"))
    )
    start, end = (_cycle(tuple(s[i] for s in schedules), F.col("source_rank")) for i in (0, 1))

    def occurrence(k: Column) -> Column:
        words = F.when(k < F.col("full"), F.col("size")).otherwise(F.col("last_words"))
        middle = (k * F.col("source_size") + F.col("offset")).cast("double") + words.cast("double") / 2
        share = F.least(F.when(F.col("target") > 0, middle / F.col("target")).otherwise(0.0), F.lit(1.0))
        return F.struct(k.cast("int").alias("pass"), words.alias("words"), invert_demand(share, start, end).alias("position"))

    occurrences = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.col("full")), occurrence), lambda o: o["words"] > 0)
    return placed.withColumn("occurrences", occurrences).select(
        "doc_id",
        *[F.col(f"kept_{c}").alias(c) for c in keep],
        "size",
        "source_size",
        "target",
        "taken",
        F.size("occurrences").alias("passes"),
        F.get("occurrences", F.lit(0))["position"].alias("position"),
        "occurrences",
        (F.col("mix_hash") / float(16**15)).alias("tie"),
    )


def in_training_order(mixed: DataFrame) -> DataFrame:
    """Range-sorted by position; documents that are never taken come last, spread by their hash."""
    return mixed.orderBy(F.coalesce(F.col("position"), 1.0 + F.col("tie")), "doc_id").drop("tie")


def training_sequence(mixed: DataFrame) -> DataFrame:
    """One row per occurrence, range-sorted by position: doc_id, pass, words, position."""
    return mixed.select("doc_id", F.explode("occurrences").alias("o")).select("doc_id", "o.*").orderBy("position", "doc_id", "pass")
