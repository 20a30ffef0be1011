"""Distance and prominence of peaks in series that are cut into chunks of time.

Both are decided within chunks as far as a chunk's rows can decide them. What is left is small: peaks near a chunk's ends
whose neighbours are not settled, which are solved cluster by cluster, and peaks that no row of their chunk overtops, for
which each chunk leaves a summary of how low the series lies before something higher comes.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.timebuckets import floor_us
from strandline.operators.scans import cut
from strandline.params import DEFAULTS


def _kinds(frame: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{k} {frame.schema[k].dataType.simpleString()}" for k in keys)


def settle_by_height(us: np.ndarray, value: np.ndarray, distance: int, low: float, high: float, kept: np.ndarray | None = None) -> np.ndarray:
    """1 for peaks (in time order) that stay, 0 for those that go, -1 for those that peaks outside [low, high) may decide.

    The highest stays, of equal ones the latest, and takes all nearer than ``distance`` out; then the next. ``kept`` marks
    peaks that are known to stay.
    """
    out = np.full(len(us), -2)
    if kept is not None:
        out[kept] = 1
    for k in np.lexsort((us, value))[::-1].tolist():
        if out[k] != -2:
            continue
        near = slice(np.searchsorted(us, us[k] - distance, "right"), np.searchsorted(us, us[k] + distance, "left"))
        open_end = us[k] - distance < low or us[k] + distance > high
        out[k] = 0 if (out[near] == 1).any() else -1 if open_end or (out[near] == -1).any() else 1
    return out


def apart(tops: DataFrame, keys: list[str], distance: int, chunk: int = DEFAULTS.chunk) -> DataFrame:
    """The ``tops`` (keys, us, value) that stay when each takes out all lower ones nearer than ``distance``, the highest first."""
    width = max(chunk, 8 * distance)
    kinds = _kinds(tops, keys)

    def within(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("us")
        low = int(frame["chunk_"].iloc[0])
        state = settle_by_height(frame["us"].to_numpy(), frame["value"].to_numpy(), distance, low, low + width)
        return frame.assign(kept=state == 1)[state != 0][[*keys, "us", "value", "kept"]]

    def left_open(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("us")
        state = settle_by_height(frame["us"].to_numpy(), frame["value"].to_numpy(), distance, -np.inf, np.inf, frame["kept"].to_numpy(dtype=bool))
        return frame[state == 1][[*keys, "us", "value"]]

    rows = tops.select(*keys, "us", "value", floor_us(F.col("us"), width).alias("chunk_"))
    settled = rows.groupBy(*keys, "chunk_").applyInPandas(within, f"{kinds}, us long, value double, kept boolean")
    # Hardly more than one peak for every distance is left: a scan of these alone is short.
    in_time = Window.partitionBy(*keys).orderBy("us")
    opens = F.coalesce(F.col("us") - F.lag("us").over(in_time) >= distance, F.lit(True))
    clusters = settled.withColumn("opens", opens.cast("int")).withColumn("cluster", F.sum("opens").over(in_time))
    clusters = clusters.withColumn("open", F.max(~F.col("kept")).over(Window.partitionBy(*keys, "cluster"))).select(*keys, "us", "value", "kept", "cluster", "open")
    solved = clusters.filter("open").groupBy(*keys, "cluster").applyInPandas(left_open, f"{kinds}, us long, value double")
    return clusters.filter("NOT open").select(*keys, "us", "value").unionByName(solved)


def lowest_since_higher(v: np.ndarray) -> np.ndarray:
    """For each place the least value since the last strictly higher one, by a stack of falling values: linear in time."""
    lowest = np.empty(len(v))
    heights: list[float] = []
    lows: list[float] = []
    for k, x in enumerate(v.tolist()):
        low = x
        while heights and heights[-1] <= x:
            heights.pop()
            low = min(low, lows.pop())
        heights.append(x)
        lows.append(low)
        lowest[k] = low
    return lowest


def looking_back(v: np.ndarray) -> tuple[list[float], list[float]]:
    """How low a chunk lies for one who looks back from behind it: (caps, lows).

    From the height x one sees down to ``lows[j]`` where ``caps[j]`` is the first cap above x; from the last cap on, the
    chunk's maximum, one sees all of it and beyond. Neighbours with one low are one entry.
    """
    caps, lows, back = [], [], v[::-1]
    least = np.minimum.accumulate(back).tolist()
    for k in np.flatnonzero(back > np.maximum.accumulate(np.concatenate([[-np.inf], back[:-1]]))).tolist():
        # back[k] is higher than all behind it: it hides what is before it from lower heights
        low = least[k - 1] if k else np.inf
        if lows and lows[-1] == low:
            caps[-1] = float(back[k])
        else:
            caps.append(float(back[k]))
            lows.append(low)
    return caps, lows


class Skyline:
    """Summaries of chunks in order; what is behind a higher chunk of later is merged into it."""

    def __init__(self):
        self.stack: list[tuple[float, float, list[float], list[float]]] = []

    def low_from(self, height: float) -> float:
        """The least value since the last one above ``height``."""
        least = np.inf
        for top, low, caps, lows in reversed(self.stack):
            if top > height:
                return min(least, lows[bisect_right(caps, height)])
            least = min(least, low)
        return least

    def add(self, top: float, low: float, caps: list[float], lows: list[float]) -> None:
        while self.stack and self.stack[-1][0] <= top:
            low = min(low, self.stack.pop()[1])
        self.stack.append((top, low, caps, lows))


def prominences(grid: DataFrame, tops: DataFrame, keys: list[str], chunk: int = DEFAULTS.chunk) -> DataFrame:
    """``tops`` (keys, us, value; rows of ``grid`` keys, us, value) with ``prominence``: the height over the higher of the
    lowest values before and after, each as far as nothing is higher."""
    kinds = _kinds(tops, keys)
    of_top = "us long, value double, left_low double, left_seen boolean, right_low double, right_seen boolean"
    of_chunk = "top double, low double, caps array<double>, lows array<double>, caps_ahead array<double>, lows_ahead array<double>"
    columns = [c.split()[0] for c in f"{of_top}, {of_chunk}".split(", ")]

    def within(frame: pd.DataFrame) -> pd.DataFrame:
        at = frame["chunk_"].iloc[0]
        rows = frame[frame["side"] == 0].sort_values("us")
        v, us = rows["value"].to_numpy(), rows["us"].to_numpy()
        places = np.searchsorted(us, np.sort(frame.loc[frame["side"] == 1, "us"].to_numpy()))
        before = np.maximum.accumulate(np.concatenate([[-np.inf], v[:-1]]))
        after = np.maximum.accumulate(np.concatenate([[-np.inf], v[::-1][:-1]]))[::-1]
        out = pd.DataFrame({"us": us[places], "value": v[places], "left_low": lowest_since_higher(v)[places], "left_seen": before[places] > v[places], "right_low": lowest_since_higher(v[::-1])[::-1][places], "right_seen": after[places] > v[places]})
        (caps, lows), (caps_ahead, lows_ahead) = looking_back(v), looking_back(v[::-1])
        summary = {"us": None, "top": v.max(), "low": v.min(), "caps": caps, "lows": lows, "caps_ahead": caps_ahead, "lows_ahead": lows_ahead}
        out = pd.concat([out.reindex(columns=columns).astype(object), pd.DataFrame([summary], columns=columns).astype(object)])
        out = out.where(out.notna(), None)
        return out.assign(chunk_=at, **{k: frame[k].iloc[0] for k in keys})[[*keys, "chunk_", *columns]]

    def along(frame: pd.DataFrame) -> pd.DataFrame:
        chunks = [g for _, g in frame.groupby("chunk_", sort=True)]
        tops_of = [g[g["us"].notna()] for g in chunks]
        ends = [g[g["us"].isna()].iloc[0] for g in chunks]
        lows = {side: {} for side in ("left", "right")}
        for side, caps, below, order in (("left", "caps", "lows", range(len(chunks))), ("right", "caps_ahead", "lows_ahead", range(len(chunks) - 1, -1, -1))):
            line = Skyline()
            for k in order:
                for us, height, low, seen in zip(tops_of[k]["us"], tops_of[k]["value"], tops_of[k][f"{side}_low"], tops_of[k][f"{side}_seen"], strict=True):
                    lows[side][us] = low if seen else min(low, line.low_from(height))
                line.add(ends[k]["top"], ends[k]["low"], list(ends[k][caps]), list(ends[k][below]))
        done = frame[frame["us"].notna()]
        return done.assign(left_low=done["us"].map(lows["left"]), right_low=done["us"].map(lows["right"]))[[*keys, "us", "value", "left_low", "right_low"]]

    both = grid.select(*keys, "us", "value", F.lit(0).alias("side")).unionByName(tops.select(*keys, "us", "value", F.lit(1).alias("side")))
    chunked = cut(both.withColumn("chunk_", floor_us(F.col("us"), chunk)).groupBy(*keys, "chunk_").applyInPandas(within, f"{kinds}, chunk_ long, {of_top}, {of_chunk}"))
    inner = chunked.filter("us IS NOT NULL AND left_seen AND right_seen").select(*keys, "us", "value", "left_low", "right_low")
    outer = chunked.filter("us IS NULL OR NOT left_seen OR NOT right_seen").groupBy(*keys).applyInPandas(along, f"{kinds}, us long, value double, left_low double, right_low double")
    return inner.unionByName(outer).select(*keys, "us", "value", (F.col("value") - F.greatest("left_low", "right_low")).alias("prominence"))
