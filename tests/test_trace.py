"""The curve of a plot against a plain scan from left to right."""

import statistics
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import trace

PIXELS = "image int, px long, py long, hue int, saturation int, brightness int"
PLOTS = "image int, x0 int, y0 int, x1 int, y1 int, slope double, intercept double, start_ts timestamp_ntz, end_ts timestamp_ntz"
K = ["image"]


def plot(spark, *images, width=200, height=300):
    start, end = datetime(2025, 1, 1), datetime(2025, 1, 11)
    return spark.createDataFrame([(i, 75, 20, 75 + width, 20 + height, -0.125, 60.0, start, end) for i in images], PLOTS)


def pixels(spark, image, columns):
    """Lit pixels of columns {x: rows}, counted from the plot's corner."""
    rows = [(image, 75 + x, 20 + y, 120, 255, 255) for x, ys in columns.items() for y in ys]
    return spark.createDataFrame(rows, PIXELS)


def scan(columns):
    out, before = {}, None
    for x in sorted(columns):
        ys = sorted(y for y in set(columns[x]) if not (6 <= x < 164 and 6 <= y < 44))
        if not ys or len(ys) > 8:
            continue
        narrow = len(ys) <= 3 or before is None
        before = statistics.median(ys) if narrow else float(ys[0] if abs(ys[0] - before) > abs(ys[-1] - before) else ys[-1])
        out[x] = before
    return out


@pytest.mark.parametrize("seed", range(3))
def test_strokes_follow_the_row_before_them(spark, seed):
    draw = np.random.default_rng(seed)
    columns = {}
    for x in range(200):
        n = int(draw.choice([0, 1, 2, 3, 4, 6, 8, 9], p=[0.05, 0.05, 0.05, 0.05, 0.35, 0.2, 0.2, 0.05]))
        low = int(draw.integers(40, 60))  # strokes that overlap: chains of columns that turn each other
        columns[x] = [int(y) for y in low + draw.choice(12, n, replace=False)]
    both = pixels(spark, 1, columns).unionByName(pixels(spark, 1, columns))  # pixels given twice
    got = trace.trace(both, plot(spark, 1), K).filter("row IS NOT NULL").collect()
    assert {r.x: r.row for r in got} == scan(columns)


def test_what_is_dropped_and_what_rejects_an_image(spark):
    line = {x: [100 + (x // 40), 101 + (x // 40)] for x in range(200)}
    line[50] = list(range(100, 120))  # too many rows
    line[90] = [180]  # a dot 10 units off: farther than the median allows
    few = {x: [100] for x in range(80)}  # 80 of 200 columns
    other = pixels(spark, 3, line).withColumn("hue", F.lit(60))
    shade = pixels(spark, 3, line).withColumn("saturation", F.lit(20))
    lit = pixels(spark, 1, line).unionByName(pixels(spark, 2, few)).unionByName(other).unionByName(shade)
    lit = lit.unionByName(spark.createDataFrame([(1, 10, 100, 120, 255, 255), (1, 80, 500, 120, 255, 255), (None, 80, 30, 120, 255, 255), (1, None, None, None, None, None), (9, 80, 100, 120, 255, 255)], PIXELS))
    traced = trace.trace(lit, plot(spark, 1, 2, 3), K)
    verdicts = {(r.image, r.x): r.verdict for r in traced.collect()}
    assert verdicts[1, 50] == "wide" and verdicts[1, 90] == "outlier" and {v for (i, _), v in verdicts.items() if i == 2} == {"uncovered"}
    assert {i for i, _ in verdicts} == {1, 2} and sum(v == "kept" for v in verdicts.values()) == 198
    reports = {r.image: r for r in trace.report(traced, plot(spark, 1, 2, 3), K).collect()}
    assert (reports[1].rows_raw, reports[1].columns_dropped_width, reports[1].rows_dropped_outlier, reports[1].rows_kept, reports[1].rejected) == (199, 1, 1, 198, False)
    assert (reports[2].coverage, reports[2].rejected, reports[3].rows_raw, reports[3].rejected) == (0.4, True, 0, True)
    kept = {r.ts: r.value for r in trace.curve(traced, K).collect()}
    assert kept[datetime(2025, 1, 1)] == 60 - 0.125 * (20 + 100.5) and len(kept) == 198


def test_no_pixels_and_no_plots(spark):
    none = pixels(spark, 1, {1: [50]}).limit(0)
    assert trace.trace(none, plot(spark, 1), K).collect() == []
    assert trace.trace(pixels(spark, 1, {1: [50]}), plot(spark, 1).limit(0), K).collect() == []
