"""Every threshold of the screening chain, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Grid:
    west: float = -122.62
    south: float = 37.42
    east: float = -121.92
    north: float = 38.18
    cell: float = 0.005

    @property
    def max_col(self) -> int:
        return int((self.east - self.west) / self.cell)

    @property
    def max_row(self) -> int:
        return int((self.north - self.south) / self.cell)


BAY = Grid()
TOKYO = Grid(139.62, 34.90, 140.13, 35.69)


@dataclass(frozen=True)
class Segmentation:
    time_gap_s: int = 1800
    distance_nm: float = 5.0
    speed_kn: float = 60.0


@dataclass(frozen=True)
class PatternGates:
    min_sog: float = 1.0
    min_points: int = 50
    min_tracks: int = 5


@dataclass(frozen=True)
class Encounter:
    bin_s: int = 60
    max_age_s: int = 60
    min_sog: float = 1.0
    distance_nm: float = 2.0
    dcpa_nm: float = 0.5
    tcpa_min: float = 15.0
    gap_s: int = 900


@dataclass(frozen=True)
class Future:
    lookahead_s: int = 900
    step_s: int = 30
    max_edge_s: int = 180
    support_nm: float = 0.5
    near_nm: float = 1.0
    min_fraction: float = 0.70
    max_uncovered_s: int = 180
    tolerance_s: int = 60


@dataclass(frozen=True)
class Hotspot:
    encounter_weight: float = 0.75
    top_share: float = 0.10
    min_points: int = 100
    min_moving: int = 20
    min_anomalies: int = 20
    min_encounters: int = 20
    low_support_weight: float = 0.25


@dataclass(frozen=True)
class Matching:
    exclusion_s: int = 900
    thinning_s: int = 900
    block_deg: float = 0.05
    band_nm: float = 0.5
    hours: int = 4
    time_caliper_s: int = 3600
    speed_caliper_kn: float = 5.0
    closing_caliper_kn: float = 2.5
    skew_norm_s: float = 60.0
    draws: int = 2000
    seed: int = 20260722
