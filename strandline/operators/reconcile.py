"""Merging several recordings of one signal: offsets between sources, a common grid, winners, audits."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.timebuckets import HOUR, floor_us, from_micros, micros, round_us
from strandline.operators.scans import cut, neighbours
from strandline.params import DEFAULTS, Params

@dataclass(frozen=True)
class Sources:
    """What is known of a signal's sources, which are few: their resolution (smaller is better), the anchor, the archive.

    Sources that are not named get ``other``; the archive ranks last. Without an anchor the first name by order serves.
    """

    resolution: Mapping[str, float] = field(default_factory=dict)
    anchor: str | None = None
    archive: str | None = None
    other: float = 1.0

    @classmethod
    def from_table(cls, table: DataFrame, most: int = 10_000) -> Sources:
        """From a small table (source, resolution, is_anchor, is_archive); more than ``most`` rows are an error."""
        rows = table.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} sources")
        marked = lambda name: min((r.source for r in rows if r[name]), default=None)
        return cls({r.source: r.resolution for r in rows if r.resolution is not None}, marked("is_anchor"), marked("is_archive"))

    def resolution_of(self, source: Column) -> Column:
        named = {**self.resolution, **({self.archive: float("inf")} if self.archive else {})}
        if not named:
            return F.lit(self.other)
        known = F.create_map(*[F.lit(x) for name, value in named.items() for x in (name, float(value))])
        return F.coalesce(F.try_element_at(known, source), F.lit(self.other))


ANY = Sources()


def bucket_means(samples: DataFrame, keys: list[str], width: int) -> DataFrame:
    return samples.groupBy(*keys, from_micros(floor_us(micros("ts"), width)).alias("bucket")).agg(F.avg("value").alias("mean_value"), F.count("*").alias("n_rows"))


def pairwise_offsets(samples: DataFrame, series: list[str], p: Params = DEFAULTS) -> DataFrame:
    """Median and spread of the differences of hourly means for each pair of sources that share enough hours."""
    means = bucket_means(samples, [*series, "source"], p.align_bucket)
    left = means.select(*series, "bucket", F.col("source").alias("source_i"), F.col("mean_value").alias("mean_i"))
    right = means.select(*series, "bucket", F.col("source").alias("source_j"), F.col("mean_value").alias("mean_j"))
    d = left.join(right, [*series, "bucket"]).filter("source_i < source_j").withColumn("d", F.col("mean_i") - F.col("mean_j"))
    fits = d.groupBy(*series, "source_i", "source_j").agg(F.count("*").alias("overlap"), F.median("d").alias("beta"), F.stddev_pop("d").alias("residual_std"))
    return fits.filter(F.col("overlap") >= p.pair_overlap)


def median_offset(samples: DataFrame, series: list[str], source_i: str, source_j: str, p: Params = DEFAULTS, least: int = 3) -> DataFrame:
    """How far one source lies above another: the median difference of their bucket medians, and the buckets both have."""
    mid = samples.groupBy(*series, "source", floor_us(micros("ts"), p.merge_bucket).alias("bucket_us")).agg(F.median("value").alias("v"))
    left, right = (mid.filter(F.col("source") == name).select(*series, "bucket_us", F.col("v").alias(side)) for name, side in ((source_i, "i"), (source_j, "j")))
    both = left.join(right, [*series, "bucket_us"]).groupBy(*series).agg(F.median(F.col("i") - F.col("j")).alias("offset"), F.count("*").alias("n_common"))
    return both.filter(F.col("n_common") >= least)


def solve_offsets(samples: DataFrame, fits: DataFrame, series: list[str], known_sources: Sources = ANY) -> DataFrame:
    """Per series and source the offset b: least squares of b_i - b_j = beta with the anchor (else the first name) at 0.

    A source that no chain of pairs ties to the anchor gets 0 and ``reachable`` false. The system of a series has as
    many unknowns as sources.
    """
    sources = samples.groupBy(*series).agg(F.collect_set("source").alias("sources"))
    pairs = fits.groupBy(*series).agg(F.collect_list(F.struct("source_i", "source_j", "beta")).alias("pairs"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                names = sorted(r["sources"])
                pin = known_sources.anchor if known_sources.anchor in names else names[0]
                edges = [(e["source_i"], e["source_j"], e["beta"]) for e in (r["pairs"] if r["pairs"] is not None else [])]
                known, grown = {pin}, True
                while grown:
                    more = {y for i, j, _ in edges for x, y in ((i, j), (j, i)) if x in known} - known
                    known |= more
                    grown = bool(more)
                free = [s for s in names if s in known and s != pin]
                used = [e for e in edges if e[0] in known and e[1] in known]
                b = dict.fromkeys(names, 0.0)
                if free and used:
                    a = np.zeros((len(used), len(free)))
                    for k, (i, j, _) in enumerate(used):
                        if i != pin:
                            a[k, free.index(i)] += 1
                        if j != pin:
                            a[k, free.index(j)] -= 1
                    b |= dict(zip(free, np.linalg.lstsq(a, np.array([e[2] for e in used]), rcond=None)[0].tolist(), strict=True))
                rows += [{**{k: r[k] for k in series}, "source": s, "b": b[s], "reachable": s in known, "pairs_used": sum(s in e[:2] for e in used)} for s in names]
            yield pd.DataFrame(rows)

    schema = ", ".join([f"{k} {samples.schema[k].dataType.simpleString()}" for k in series]) + ", source string, b double, reachable boolean, pairs_used int"
    return sources.join(pairs, series, "left").mapInPandas(solve, schema)


def apply_offsets(samples: DataFrame, offsets: DataFrame, series: list[str]) -> DataFrame:
    joined = samples.join(offsets.select(*series, "source", "b"), [*series, "source"], "left")
    return joined.withColumn("value", F.col("value") - F.coalesce("b", F.lit(0.0))).drop("b")


def apply_anchor(samples: DataFrame, fits: DataFrame, series: list[str]) -> DataFrame:
    """``samples`` mapped to the anchor's frame, a * value + b, for the sources whose fit asks for it (``apply``)."""
    wanted = fits.filter("apply").select(*series, "source", F.col("a").alias("map_a"), F.col("b").alias("map_b"))
    mapped = samples.join(wanted, [*series, "source"], "left")
    return mapped.withColumn("value", F.coalesce(F.col("map_a") * F.col("value") + F.col("map_b"), F.col("value"))).drop("map_a", "map_b")


def overlay(samples: DataFrame, fits: DataFrame, offsets: DataFrame, series: list[str]) -> DataFrame:
    """Every source as it enters the merge: mapped to the anchor where needed, then freed of its offset."""
    return apply_offsets(apply_anchor(samples, fits, series), offsets, series)


def densify(samples: DataFrame, keys: list[str], p: Params = DEFAULTS) -> DataFrame:
    """Time-linear values on the merge grid, where a sample is near enough: keys, bucket_us, value.

    The grid runs from the first to the last sample's whole bucket; points whose nearest sample is farther than three
    median strides (15 minutes at least) are left out. Of samples at one time the one with the largest event_id counts.
    """
    distinct = samples.groupBy(*keys, micros("ts").alias("us")).agg(F.max_by("value", "event_id").alias("value"))
    steps = neighbours(distinct, keys, F.struct("us", "value"), [], p.chunk, strict=True, keep=["value"]).select(*keys, "us", "value", F.col("a.us").alias("next_us"), F.col("a.value").alias("next_value"))
    median = F.median(F.col("next_us") - F.col("us"))
    limits = steps.groupBy(*keys).agg(F.greatest(p.gap_strides * median, F.lit(p.gap_floor)).alias("limit"), F.count("next_us").alias("n")).filter("n > 0")
    # Each sample lays out the grid from its own time to the next sample's, as far as one of the two is near enough.
    width, until = p.merge_bucket, F.coalesce(F.col("next_us") - 1, F.col("us"))
    up, down = (lambda us: F.ceil(us / F.lit(width)).cast("long") * width), (lambda us: F.floor(us / F.lit(width)).cast("long") * width)
    line = lambda low, high: F.when(low <= high, F.sequence(low, high, F.lit(width))).otherwise(F.array().cast("array<bigint>"))
    after_it = line(up(F.col("us")), down(F.least(until, F.col("us") + F.floor("limit").cast("long"))))
    before_next = line(up(F.greatest(F.col("next_us") - F.floor("limit").cast("long"), F.col("us") + F.floor("limit").cast("long") + 1)), down(until))
    points = F.explode(F.concat(after_it, F.coalesce(before_next, F.array().cast("array<bigint>"))))
    # Of a single sample there is no stride: it gives no grid.
    full = steps.join(limits, keys).select(*keys, F.col("us").alias("b_us"), "value", "next_us", "next_value", points.alias("us"))
    share = F.when(F.col("us") > F.col("b_us"), (F.col("us") - F.col("b_us")) / (F.col("next_us") - F.col("b_us"))).otherwise(0.0)
    end = F.when(F.col("us") > F.col("b_us"), F.col("next_value")).otherwise(F.col("value"))
    return full.select(*keys, F.col("us").alias("bucket_us"), (F.col("value") + (end - F.col("value")) * share).alias("value"))


def tagged(samples: DataFrame, series: list[str], p: Params = DEFAULTS) -> DataFrame:
    """One row per (series, bucket, source): the latest actual sample, or the grid value where the source has none."""
    keys = [*series, "bucket_us", "source"]
    actual = samples.withColumns({"us": micros("ts"), "bucket_us": round_us(micros("ts"), p.merge_bucket)})
    last = actual.groupBy(*keys).agg(F.max_by(F.struct("us", "value"), F.struct("us", "event_id")).alias("s")).select(*keys, "s.us", "s.value", F.lit(True).alias("actual"))
    grid = densify(samples, [*series, "source"], p).join(last.select(*keys), keys, "left_anti")
    return last.unionByName(grid.select(*keys, F.col("bucket_us").alias("us"), "value", F.lit(False).alias("actual")))


def merge(samples: DataFrame, series: list[str], sources: Sources = ANY, p: Params = DEFAULTS) -> DataFrame:
    """One row per (series, bucket): the finest source wins.

    With an actual sample of the winner that sample is emitted; else the winner's grid value at the time of the
    bucket's first actual sample, or at the bucket itself. ``n_sources`` counts the sources present.
    """
    rows = tagged(samples, series, p).withColumn("resolution", sources.resolution_of(F.col("source")))
    picked = rows.groupBy(*series, "bucket_us").agg(
        F.min_by(F.struct("source", "us", "value", "actual"), F.struct("resolution", "us", "source")).alias("w"),
        F.min(F.when(F.col("actual"), F.col("us"))).alias("first_us"),
        F.count("*").alias("n_sources"),
    )
    us = F.when(F.col("w.actual"), F.col("w.us")).otherwise(F.coalesce("first_us", "bucket_us"))
    return picked.select(*series, from_micros(F.col("bucket_us")).alias("bucket"), from_micros(us).alias("ts"), F.col("w.value").alias("value"), F.col("w.source").alias("winner"), "n_sources")


def outlier_audit(samples: DataFrame, series: list[str], p: Params = DEFAULTS) -> DataFrame:
    """Actual values far from their bucket's median, in buckets with two sources or more: for the log only."""
    keys = [*series, "bucket_us"]
    actual = samples.withColumn("bucket_us", round_us(micros("ts"), p.merge_bucket))
    last = actual.groupBy(*keys, "source").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    centre = last.groupBy(*keys).agg(F.median("value").alias("bucket_median"), F.count("*").alias("k")).filter("k >= 2")
    off = last.join(centre, keys).withColumn("delta", F.abs(F.col("value") - F.col("bucket_median")))
    mad = off.groupBy(*keys).agg(F.median("delta").alias("mad"))
    limit = F.greatest(F.lit(p.mad_floor), p.mad_factor * 1.4826 * F.col("mad"))
    return off.join(mad, keys).filter(F.col("delta") > limit).select(*series, from_micros(F.col("bucket_us")).alias("bucket"), "source", "value", "bucket_median", "delta")


def handoff_clusters(merged: DataFrame, series: list[str], p: Params = DEFAULTS) -> DataFrame:
    """``merged`` with ``touched``, whether a flip between one source and several may change a row or read it, and ``group``.

    A flip reads the rows to both sides of it and changes those within ``p.blend_hours``. A cluster is a stretch of touched
    rows; clusters don't depend on each other. Rows of one cluster have one ``group``, others that of their chunk of time.
    """
    span, kept = int(p.blend_hours * HOUR), [c for c in merged.columns if c not in series]
    rows = cut(merged.withColumn("us", micros("ts")))
    seen = neighbours(rows, series, F.struct("us", (F.col("n_sources") >= 2).alias("several")), ["bucket"], p.chunk, strict=True, keep=kept)
    flips = F.when((F.col("n_sources") >= 2) != F.col("b.several"), F.struct("us", F.least(F.col("b.us"), F.col("us") - span).alias("since")))
    near = neighbours(seen, series, flips, ["bucket"], p.chunk, keep=kept)
    near = cut(near)
    touched = F.coalesce(F.col("us") <= F.col("b.us") + span, F.lit(False)) | F.coalesce(F.col("us") >= F.col("a.since"), F.lit(False))
    named = neighbours(near.withColumn("touched", touched), series, F.when(~F.col("touched"), F.col("us")), ["bucket"], p.chunk, keep=[*kept, "touched"])
    group = F.when(F.col("touched"), F.coalesce("b", F.lit(-1).cast("long"))).otherwise(floor_us(F.col("us"), p.chunk))
    return named.select(*merged.columns, "touched", group.alias("group"))


def blend_handoffs(merged: DataFrame, series: list[str], p: Params = DEFAULTS) -> DataFrame:
    """Soften steps where the number of sources flips between one and several.

    Every flip with a step above ``p.step`` is spread over the rows within ``p.blend_hours``, in time order, each seeing
    what the earlier ones changed; so a cluster of flips whose rows meet is folded by one task, whatever the series.
    """

    columns = merged.columns

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        if not frame["touched"].iloc[0]:
            return frame[columns]
        frame = frame.sort_values(["ts", "bucket"]).reset_index(drop=True)
        v, several = frame["value"].to_numpy(dtype=float).copy(), (frame["n_sources"] >= 2).to_numpy()
        hours = frame["ts"].astype("datetime64[us]").astype("int64").to_numpy() / 3.6e9
        for k in np.flatnonzero(several[1:] != several[:-1]) + 1:
            many, one = (k - 1, k) if several[k - 1] else (k, k - 1)
            step = v[one] - v[many]
            if abs(step) <= p.step:
                continue
            near = slice(np.searchsorted(hours, hours[k] - p.blend_hours, "left"), np.searchsorted(hours, hours[k] + p.blend_hours, "right"))
            weight = np.clip(1 - np.abs(hours[near] - hours[k]) / p.blend_hours, 0, 1)
            v[near] += np.where(several[near], 0.5, -0.5) * step * weight
        return frame.assign(value=v)[columns]

    return handoff_clusters(merged, series, p).groupBy(*series, "touched", "group").applyInPandas(fold, merged.schema)


def fill_from_archive(merged: DataFrame, archive: DataFrame, series: list[str], p: Params = DEFAULTS) -> DataFrame:
    """``merged`` (series, bucket, ts, value) plus the archive's last row of every bucket that is not live."""
    old = archive.withColumn("bucket", from_micros(round_us(micros("ts"), p.merge_bucket)))
    last = old.groupBy(*series, "bucket").agg(F.max_by(F.struct("ts", "value"), F.struct("ts", "event_id")).alias("s")).select(*series, "bucket", "s.ts", "s.value")
    missing = last.join(merged.select(*series, "bucket"), [*series, "bucket"], "left_anti")
    return merged.select(*series, "bucket", "ts", "value", F.lit(True).alias("live")).unionByName(missing.withColumn("live", F.lit(False)))


def winner_counts(merged: DataFrame, series: list[str]) -> DataFrame:
    counts = merged.groupBy(*series, "winner").agg(F.count("*").alias("buckets"))
    return counts.withColumn("share", F.col("buckets") / F.sum("buckets").over(Window.partitionBy(*series)))


def anchor_fits(samples: DataFrame, series: list[str], anchor: str, trim_hours: float = 6.0, least: int = 50, slope_limit: float = 0.03, level_limit: float = 5.0) -> DataFrame:
    """Robust line anchor = a * source + b over shared hours, the anchor trimmed at both ends: a, b, overlap, residual_std, apply.

    A source with too few shared hours has nulls. ``apply`` is set where the line is far from the identity.
    """
    from strandline.functions.robust import huber_line

    hours = bucket_means(samples, [*series, "source"], DEFAULTS.align_bucket)
    ends = samples.filter(F.col("source") == anchor).groupBy(*series).agg(F.min("ts").alias("low"), F.max("ts").alias("high"))
    trim = F.make_dt_interval(F.lit(0), F.lit(int(trim_hours)))
    truth = hours.filter(F.col("source") == anchor).join(ends, series).filter((F.col("bucket") >= F.col("low") + trim) & (F.col("bucket") <= F.col("high") - trim))
    both = hours.filter(F.col("source") != anchor).join(truth.select(*series, "bucket", F.col("mean_value").alias("truth")), [*series, "bucket"])

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = {**dict(zip([*series, "source"], key, strict=True)), "overlap": len(rows), "a": None, "b": None, "residual_std": None, "apply": False}
        if len(rows) >= least:
            line = huber_line(rows["mean_value"].to_numpy(), rows["truth"].to_numpy(), 1.0)
            rest = rows["truth"] - line(rows["mean_value"].to_numpy())
            out |= {"a": line.slope, "b": line.intercept, "residual_std": float(rest.std(ddof=0)), "apply": abs(line.slope - 1) > slope_limit or abs(line.intercept) > level_limit}
        return pd.DataFrame([out])

    kinds = ", ".join(f"{k} {samples.schema[k].dataType.simpleString()}" for k in series)
    return both.groupBy(*series, "source").applyInPandas(fit, f"{kinds}, source string, overlap long, a double, b double, residual_std double, apply boolean")


def straight_or_bent(points: DataFrame, keys: list[str]) -> DataFrame:
    """Residual spread of a straight line and of a parabola of y over x: std_line, std_bent, bent (clearly better).

    The parabola's gain is that of x squared after both y and x squared are freed of their straight lines.
    """
    w = Window.partitionBy(*keys)
    centred = points.withColumn("x", F.col("x") - F.avg("x").over(w)).withColumn("xx", F.col("x") * F.col("x"))
    free = lambda y: F.col(y) - (F.regr_slope(y, "x").over(w) * F.col("x") + F.regr_intercept(y, "x").over(w))
    rest = centred.select(*keys, free("y").alias("ry"), free("xx").alias("rx"))
    sums = rest.groupBy(*keys).agg(F.sum(F.col("ry") ** 2).alias("yy"), F.sum(F.col("rx") * F.col("ry")).alias("xy"), F.sum(F.col("rx") ** 2).alias("xx"), F.count("*").alias("n"))
    bent = F.greatest(F.col("yy") - F.coalesce(F.col("xy") ** 2 / F.nullif("xx", F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    both = sums.select(*keys, F.sqrt(F.col("yy") / F.col("n")).alias("std_line"), F.sqrt(bent / F.col("n")).alias("std_bent"))
    return both.withColumn("bent", F.col("std_bent") < 0.6 * F.col("std_line"))
