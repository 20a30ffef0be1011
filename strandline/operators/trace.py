"""A curve read from the coloured pixels of plots, column by column.

Images are rows (keys, px, py, hue, saturation, brightness) with hues of 0 to 180; ``plots`` has a row per image with its
box and axes (keys, x0, y0, x1, y1, slope, intercept, start_ts, end_ts). Images of null keys have no plot and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.state import pixels_to_data
from strandline.operators.windows import outlier_flags, rate_flags
from strandline.params import DEFAULTS, Params

# The curve's colour, and where the legend stands in the plot (x from, y from, x to, y to).
HUES = (100, 130)
LEAST_SATURATION = 100
LEAST_BRIGHTNESS = 50
LEGEND = (6, 6, 164, 44)
# Lit pixels of a column beyond which it is a crossing stroke and beyond which no curve, and the share of columns that must be lit.
STROKE = 3
WIDEST = 8
LEAST_COVERAGE = 0.5


def is_curve() -> Column:
    return F.col("hue").between(*HUES) & (F.col("saturation") >= LEAST_SATURATION) & (F.col("brightness") >= LEAST_BRIGHTNESS)


def lit_columns(pixels: DataFrame, plots: DataFrame, keys: list[str]) -> DataFrame:
    """keys, x, n_lit, top, middle, bottom of every column of a plot that holds the curve's colour outside the legend.

    x and the rows count from the plot's corner, rows downwards; the middle is the median of the lit rows. A pixel that is
    given twice counts once.
    """
    inside = (F.col("px") >= F.col("x0")) & (F.col("px") < F.col("x1")) & (F.col("py") >= F.col("y0")) & (F.col("py") < F.col("y1"))
    left, upper, right, lower = LEGEND
    x, y = F.col("px") - F.col("x0"), F.col("py") - F.col("y0")
    legend = (x >= left) & (x < right) & (y >= upper) & (y < lower)
    lit = pixels.filter(is_curve()).select(*keys, "px", "py").join(plots.select(*keys, "x0", "y0", "x1", "y1"), keys).filter(inside & ~legend)
    rows = lit.groupBy(*keys, x.alias("x")).agg(F.sort_array(F.collect_set(y)).alias("rows"))
    n = F.size("rows")
    middle = (F.element_at("rows", F.floor((n + 1) / 2).cast("int")) + F.element_at("rows", F.floor(n / 2).cast("int") + 1)) / 2.0
    return rows.select(*keys, "x", n.alias("n_lit"), F.element_at("rows", 1).cast("double").alias("top"), middle.alias("middle"), F.element_at("rows", -1).cast("double").alias("bottom"))


def followed(columns: DataFrame, keys: list[str]) -> DataFrame:
    """``columns`` with the ``row`` of the curve: the middle of a narrow column and of an image's first; of a stroke the
    end that lies farther from the row before it, the bottom of two as far.

    What a stroke takes depends on what the column before took, and so on. A row above the stroke's centre takes its bottom,
    one below it its top. So a column before it whose both ends lie on one side decides the stroke by itself, and
    one with an end on each side always turns it round: the row of a stroke is that of the last decided column, turned as
    often as there are columns since. No column waits for another one.
    """
    order = Window.partitionBy(*keys).orderBy("x")
    before = lambda c: F.lag(c).over(order)
    narrow = F.col("n_lit") <= STROKE
    centre = (F.col("top") + F.col("bottom")) / 2
    placed = columns.withColumn("k_", F.row_number().over(order)).withColumn("sure_", narrow | (F.col("k_") == 1))
    upwards = F.when(before("sure_"), before("middle") > centre).when((before("top") > centre) == (before("bottom") > centre), before("top") > centre)
    decided = F.when(F.col("sure_"), F.struct("k_", F.lit(False).alias("up"))).when(upwards.isNotNull(), F.struct("k_", upwards.alias("up")))
    last = F.last("decided_", True).over(order)
    turned = F.pmod(F.col("k_") - F.col("last_.k_"), F.lit(2)) == 1
    up = F.col("last_.up") != turned
    row = F.when(F.col("sure_"), F.col("middle")).when(up, F.col("top")).otherwise(F.col("bottom"))
    return placed.withColumn("decided_", decided).withColumn("last_", last).withColumn("row", row).drop("k_", "sure_", "decided_", "last_")


def trace(pixels: DataFrame, plots: DataFrame, keys: list[str], p: Params = DEFAULTS) -> DataFrame:
    """keys, x, n_lit, coverage, row, ts, value and verdict of every lit column.

    Verdicts: 'uncovered' where the curve's colour is in fewer than half of the plot's columns, which rejects the image;
    'wide' for columns of more than eight lit rows; 'rate' for rows of a step too steep for the instrument; 'outlier' for
    rows far from their rolling median, judged after these are out; else 'kept'. Rejected and wide columns have no row.
    """
    columns = lit_columns(pixels, plots, keys)
    share = F.count("*").over(Window.partitionBy(*keys)) / F.greatest(F.col("width_"), F.lit(1))
    columns = columns.join(plots.select(*keys, (F.col("x1") - F.col("x0")).alias("width_")), keys).withColumn("coverage", share).drop("width_")
    first = F.when(F.col("coverage") < LEAST_COVERAGE, "uncovered").when(F.col("n_lit") > WIDEST, "wide")
    columns = columns.withColumn("early_", F.coalesce(first, F.lit("")))
    usable = F.col("early_") == ""
    rows = followed(columns, [*keys, "early_"]).withColumn("row", F.when(usable, F.col("row")))
    placed = rows.join(plots.select(*keys, "x0", "y0"), keys).withColumns({"px": F.col("x0") + F.col("x"), "py": F.col("y0") + F.col("row")}).drop("x0", "y0")
    data = pixels_to_data(placed, plots, keys).drop("per_pixel", "px", "py")
    judged = rate_flags(data, [*keys, "early_"], p).drop("marked").withColumnRenamed("dropped", "steep_")
    judged = outlier_flags(judged, [*keys, "early_", "steep_"], p)
    verdict = F.when(~usable, F.col("early_")).when(F.col("steep_"), "rate").when(F.col("dropped"), "outlier").otherwise("kept")
    return judged.select(*keys, "x", "n_lit", "coverage", "row", "ts", "value", verdict.alias("verdict"))


def curve(traced: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ts, value of what trace() keeps."""
    return traced.filter("verdict = 'kept'").select(*keys, "ts", "value")


def report(traced: DataFrame, plots: DataFrame, keys: list[str]) -> DataFrame:
    """Per plot: coverage, rows_raw, columns_dropped_width, rows_dropped_rate, rows_dropped_outlier, rows_kept, rejected."""
    n = lambda *verdicts: F.count(F.when(F.col("verdict").isin(*verdicts), 1))
    counted = traced.groupBy(*keys).agg(
        F.max("coverage").alias("coverage"), n("rate", "outlier", "kept").alias("rows_raw"), n("wide").alias("columns_dropped_width"),
        n("rate").alias("rows_dropped_rate"), n("outlier").alias("rows_dropped_outlier"), n("kept").alias("rows_kept"),
    )
    return plots.select(*keys).join(counted, keys, "left").na.fill(0).withColumn("rejected", F.col("rows_raw") == 0)
