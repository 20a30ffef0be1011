"""Episodes of a stream: build-ups between the peaks of bucket means, given out as soon as a peak closes them.

Rows wait until the watermark has passed them and are then seen in the order of time. Of a series the state holds these
rows, the open bucket, the level stretch that may become a peak, and sums of what came since the last peak: nothing that
grows with the length of the series.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandline.functions.timebuckets import HOUR, from_micros, micros
from strandline.params import DEFAULTS, Params

STATE = "wait_us array<long>, wait_value array<double>, wait_id array<long>, machine string"


class Machine:
    """One series, row by row. Its fields are plain values, so that it is stored as JSON."""

    def __init__(self, width: int, p: Params, fields: dict | None = None):
        self.width, self.p = width, p
        f = fields or {}
        self.bucket = f.get("bucket")  # start, sum and number of the values before the last time, last time, its value
        self.level = f.get("level")  # first and last bucket of equal means, their value, whether it was reached by a rise
        self.held = f.get("held", [])  # rows by bucket that a peak may still divide: start, n, [value, us, id] of the least, rows from there
        self.peak = f.get("peak")  # where the last peak stands
        self.since = f.get("since", [0, None, 0])  # rows since then: n, the least of the search span, rows from there
        self.once = f.get("once", [None, 0])  # the last row's time, and how many rows came with it
        self.seen = f.get("seen")  # rows before this time have been seen

    def fields(self) -> dict:
        return {k: v for k, v in vars(self).items() if k not in ("width", "p")}

    def row(self, us: int, value: float, event_id: int) -> Iterator[tuple]:
        start = us - us % self.width
        if self.bucket and self.bucket[0] != start:
            yield from self._mean(self.bucket[0], (self.bucket[1] + self.bucket[4]) / (self.bucket[2] + 1))
            self.bucket = None
        if self.bucket is None:
            self.bucket = [start, 0.0, 0, us, value]
        elif self.bucket[3] == us:  # of rows at one time the last counts in the mean
            self.bucket[4] = value
        else:
            _, total, n, _, last = self.bucket
            self.bucket = [start, total + last, n + 1, us, value]
        # A row at a bucket's very start belongs to the episode that ends there.
        part, least = start - self.width if us == start else start, [value, us, event_id]
        self.once = [us, self.once[1] + 1 if self.once[0] == us else 1]
        if not self.held or self.held[-1][0] != part:
            self.held.append([part, 0, None, 0])
        self.held[-1][1:] = self._joined(self.held[-1][1:], [1, least, self.once[1]])

    def close(self) -> Iterator[tuple]:
        """The open bucket's mean, where no row of it is to come."""
        if self.bucket and self.seen is not None and self.bucket[0] + self.width <= self.seen:
            yield from self._mean(self.bucket[0], (self.bucket[1] + self.bucket[4]) / (self.bucket[2] + 1))
            self.bucket = None

    def _mean(self, at: int, mean: float) -> Iterator[tuple]:
        if self.level and mean == self.level[2]:
            self.level[1] = at
            return
        if self.level and mean < self.level[2] and self.level[3]:
            first, last = self.level[:2]
            yield from self._top(first + (last - first) // (2 * self.width) * self.width)
        self.level = [at, at, mean, bool(self.level) and mean > self.level[2]]
        self._settle(at)

    def _top(self, at: int) -> Iterator[tuple]:
        self._settle(at)
        n, least, rest = self.since
        if self.peak is not None and n >= self.p.episode_rows and least and rest >= self.p.episode_rows:
            yield self.peak, at, least[1], least[0], rest
        self.peak, self.since = at, [0, None, 0]

    def _settle(self, until: int) -> None:
        """Count what is held of the buckets that end by then."""
        while self.held and self.held[0][0] + self.width <= until:
            part, n, least, rest = self.held.pop(0)
            early = self.peak is not None and part + self.width <= self.peak + self.p.trough_search
            self.since = self._joined(self.since, [n, least if early else None, rest])

    @staticmethod
    def _joined(a: list, b: list) -> list:
        """What two stretches have together, ``b`` after ``a``: n, the least row, and the rows from its time on."""
        if b[1] is None or (a[1] is not None and a[1] <= b[1]):
            return [a[0] + b[0], a[1], a[2] + b[0] if a[1] else 0]
        return [a[0] + b[0], *b[1:]]


def closed_episodes(stream: DataFrame, keys: list[str], late: str = "1 day", width: int = 12 * HOUR, p: Params = DEFAULTS) -> DataFrame:
    """keys, prev_ts, end_ts, trough_ts, trough_value, n_rows of every episode, once a peak of the means of ``width`` closes it.

    The same as peaks.episodes() between peaks.local_maxima() of peaks.hourly() for the rows that are not later than
    ``late``; rows without a time or a value are left out, and so are later ones. The last peak is known when means fall after
    it, and rows when the watermark has passed them. ``p.trough_search`` is a multiple of ``width``. One series is one key of
    the state.
    """
    if p.trough_search % width:
        raise ValueError("the search span for troughs is not a multiple of the buckets' width")
    known = stream.filter("ts IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)").withColumn("us", micros("ts"))
    timed = known.withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", late)
    rows = timed.select(*keys, "ts", "us", F.col("value").cast("double").alias("value"), F.col("event_id").cast("long").alias("event_id"))
    kinds = ", ".join(f"{k} {stream.schema[k].dataType.simpleString()}" for k in keys)
    columns = [*keys, "prev_us", "end_us", "trough_us", "trough_value", "n_rows"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ([], [], [], "{}")
        waiting = list(zip(*map(list, held[:3]), strict=True))
        machine = Machine(width, p, json.loads(held[3]))
        for batch in batches:
            new = zip(batch["us"].tolist(), batch["value"].tolist(), batch["event_id"].tolist(), strict=True)
            waiting += [r for r in new if machine.seen is None or r[0] >= machine.seen]
        mark = state.getCurrentWatermarkMs()
        now = mark * 1000 if mark > 0 else None
        ready = sorted((r for r in waiting if now is not None and r[0] < now), key=lambda r: (r[0], r[2]))
        found = [e for row in ready for e in machine.row(*row)]
        if now is not None:
            machine.seen = max(now, machine.seen or now)
            found += machine.close()
        waiting = [r for r in waiting if now is None or r[0] >= now]
        state.update(([r[0] for r in waiting], [r[1] for r in waiting], [r[2] for r in waiting], json.dumps(machine.fields())))
        ends = [r[0] // 1000 for r in waiting] + ([(machine.bucket[0] + width) // 1000] if machine.bucket else [])
        if ends:
            state.setTimeoutTimestamp(max(min(ends), mark + 1, 1))
        yield pd.DataFrame([(*key, *e) for e in found], columns=columns)

    schema = f"{kinds}, prev_us long, end_us long, trough_us long, trough_value double, n_rows long"
    out = rows.groupBy(*keys).applyInPandasWithState(step, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    at = lambda c: from_micros(F.col(f"{c}_us")).alias(f"{c}_ts")
    return out.select(*keys, at("prev"), at("end"), at("trough"), "trough_value", "n_rows")
