"""Every threshold of the engine with its default."""

from __future__ import annotations

from dataclasses import dataclass

from strandline.functions.timebuckets import DAY, HOUR, MINUTE, QUARTER


@dataclass(frozen=True)
class Params:
    #: Time of a series that a task scans at once.
    chunk: int = 30 * DAY
    merge_bucket: int = QUARTER
    align_bucket: int = HOUR
    pair_overlap: int = 20
    mad_factor: float = 3.0
    mad_floor: float = 5.0
    blend_hours: float = 6.0
    step: float = 4.0
    large_offset: float = 30.0
    warn_offset: float = 5.0
    sure_pairs: int = 3
    gap_strides: int = 3
    gap_floor: int = QUARTER
    conflict: float = 1.0
    quorum: int = 2
    neighbour: int = 30 * MINUTE
    neighbour_value: float = 3.0
    rolling_threshold: float = 4.0
    rolling_rows: int = 10
    rate_cap: float = 15.0
    rate_share: float = 0.2
    prominence: float = 4.0
    distance_days: float = 5.0
    trough_search: int = 14 * DAY
    episode_rows: int = 50
    episodes: int = 6
    episodes_least: int = 4
    late_share: float = 0.5
    late_hours: float = 168.0
    fit_rows: int = 12
    horizon_days: float = 90.0
    value_limit: float = 50.0
    phase_switch: float = 0.5
    backtest_prominence: float = 10.0
    backtest_segments: int = 7
    fractions: tuple = (0.25, 0.5, 0.75, 1.0)
    coverage: float = 0.5
    draws: int = 200


DEFAULTS = Params()
