"""Thresholds of the proximity method, grouped by the stage that uses them.

Every group is a frozen dataclass, so an analysis that needs other values
passes ``dataclasses.replace(group, field=value)`` instead of changing globals.
"""

from __future__ import annotations

import dataclasses as dc

# ---------------------------------------------------------------------------
# The numbers below define the method and have to be exactly
# these for results to be comparable with published ones.
# ---------------------------------------------------------------------------

# separation tiers: name, horizontal NM, vertical ft
TIERS = (
    ("T1", 3.0, 1000.0),
    ("T2", 0.5, 500.0),
    ("T3", 500.0 / 6076.12, 100.0),
)
KINDS = ("observed", "predicted", "any")
GEOMETRY_CLASSES = (
    "in_trail_same_runway",
    "parallel_runways",
    "crossing",
    "head_on",
    "runway_area",
    "other",
)
PROCEDURAL_CLASSES = ("in_trail_same_runway", "parallel_runways")

RAW_COLUMNS = (
    "timestamp",
    "icao24",
    "callsign",
    "latitude",
    "longitude",
    "altitude",
    "geoaltitude",
    "vertical_rate",
    "groundspeed",
    "track",
    "onground",
)
POSITION_TIME_COLUMNS = ("last_position", "lastposupdate", "time_position")

EVENT_OUTCOMES = ("go_around", "touch_and_go")
EVENT_OUTCOMES_AMBIGUOUS = ("go_around", "touch_and_go", "ga_ambiguous")
CONTROL_OUTCOMES = ("full_stop",)
EVENT_ID_PREFIX = {"go_around": "ga", "touch_and_go": "tg", "ga_ambiguous": "gx"}
GO_AROUND_OUTCOMES = ("go_around", "ga_ambiguous")
NON_ATTEMPTS = ("continued_approach",)

# presets of the approach thresholds by operating environment
PRESETS = {
    "training_ga": {},
    "air_carrier": {"touchdown_gs_kt": 80.0, "max_dist_nm": 8.0},
}

# one-at-a-time threshold grid of the outcome classifier (first = default)
OUTCOME_GRID = {
    "level_go_around_max_s": (20.0, 15.0, 25.0),
    "level_low_approach_min_s": (30.0, 25.0, 35.0),
    "regain_min_ft": (250.0, 200.0, 300.0),
    "climb_vrate_fpm": (300.0, 200.0, 400.0),
    "touchdown_plateau_min_s": (20.0, 15.0, 25.0),
    "plateau_band_ft": (60.0, 50.0, 75.0),
    "max_low_agl_ft": (1000.0, 800.0, 1200.0),
}

DAY_S = 86400
NM_PER_M = 1.0 / 1852.0
FT_PER_M = 3.28084
DEPARTURE_BASE = 100


@dc.dataclass(frozen=True)
class Cleaning:
    load_radius_nm: float = 25.0
    max_position_age_s: float = 10.0
    max_speed_kt: float = 600.0
    leg_gap_s: int = 1200
    min_points: int = 2
    geo_baro_max_dev_ft: float = 1000.0
    smooth_half_rows: int = 3
    airborne_min_gs_kt: float = 50.0
    max_interp_gap_s: int = 10
    long_interp_gap_s: int = 4
    outage_min_s: int = 60


@dc.dataclass(frozen=True)
class Volume:
    radius_nm: float = 10.0
    radius_sensitivity_nm: float = 5.0
    inner_radius_nm: float = 5.0
    ceiling_buffer_ft: float = 2000.0
    ceiling_step_ft: float = 500.0
    ceiling_cap_ft: float = 10000.0
    ceiling_sensitivity_ft: tuple = (2500.0, 5000.0, 10000.0)
    ceiling_spill_max: float = 0.10
    ceiling_min_ft: float = 1500.0
    ceiling_max_ft: float = 12000.0


@dc.dataclass(frozen=True)
class Encounter:
    lookahead_s: float = 120.0
    lookahead_sensitivity_s: tuple = (60.0, 180.0)
    step_s: float = 1.0
    merge_gap_s: int = 10
    prune_speed_kt: float = 350.0
    tier_factors: tuple = (0.75, 1.25)
    still: float = 1e-9


@dc.dataclass(frozen=True)
class Geometry:
    in_trail_max_deg: float = 30.0
    crossing_max_deg: float = 150.0
    parallel_heading_deg: float = 15.0
    runway_area_nm: float = 1.0
    runway_area_ft: float = 500.0
    phase_xtrack_nm: float = 0.5
    phase_track_deg: float = 25.0
    arrival_dist_nm: float = 12.0
    arrival_height_ft: float = 4000.0
    departure_dist_nm: float = 8.0
    departure_vrate_fpm: float = 200.0
    past_threshold_nm: float = -0.3
    departure_before_nm: float = 0.5
    xtrack_weight: float = 20.0
    flow_heading_deg: float = 30.0
    spacing_heading_deg: float = 10.0


@dc.dataclass(frozen=True)
class Approach:
    leg_gap_s: int = 1200
    min_leg_points: int = 60
    smooth_half_rows: int = 3
    max_dist_nm: float = 5.0
    max_xtrack_nm: float = 0.30
    max_track_deg: float = 25.0
    max_agl_ft: float = 1500.0
    past_threshold_nm: float = -0.3
    xtrack_weight: float = 20.0
    merge_gap_s: int = 60
    min_duration_s: int = 20
    min_reached_agl_ft: float = 800.0
    min_descent_ft: float = 100.0
    low_vote_agl_ft: float = 500.0
    low_vote_weight: float = 5.0
    aftermath_s: int = 180
    plateau_band_ft: float = 60.0
    plateau_row_gap: int = 5
    touchdown_agl_ft: float = 25.0
    touchdown_low_ft: float = 300.0
    touchdown_gs_kt: float = 50.0
    touchdown_gs_below_ft: float = 200.0
    touchdown_plateau_max_ft: float = 120.0
    touchdown_plateau_min_s: float = 20.0
    touchdown_gap_s: float = 12.0
    touchdown_gap_agl_ft: float = 150.0
    end_truncated_agl_ft: float = 350.0
    end_truncated_gap_s: float = 60.0
    end_truncated_vrate_fpm: float = 100.0
    truncated_dist_nm: float = 3.0
    truncated_agl_ft: float = 600.0
    truncated_tail_rows: int = 60
    truncated_track_rows: int = 30
    truncated_track_deg: float = 45.0
    truncated_covered_s: float = 120.0
    truncated_segment_s: float = 120.0
    climb_vrate_fpm: float = 300.0
    climb_min_s: float = 15.0
    climb_within_s: float = 120.0
    climb_row_gap: int = 3
    peak_rows: int = 90
    regain_min_ft: float = 250.0
    max_low_agl_ft: float = 1000.0
    min_observed_descent_ft: float = 150.0
    level_go_around_max_s: float = 20.0
    level_low_approach_min_s: float = 30.0
    hidden_gap_min_s: float = 5.0
    continued_gap_s: float = 240.0
    arrivals_only: bool = False


@dc.dataclass(frozen=True)
class Windows:
    window_min: int = 10
    window_sensitivity_min: tuple = (5, 15)
    flow_half_s: int = 1800
    flow_share: float = 0.70
    degraded_interp: float = 0.20
    bad_interp: float = 0.40
    degraded_gaps: float = 2.0
    bad_gaps: float = 5.0
    epoch_half_min: int = 30
    epoch_step_s: int = 60
    exclusion_min: int = 30
    exclusion_sensitivity_min: tuple = (15, 60)


@dc.dataclass(frozen=True)
class Baseline:
    min_events: int = 50
    min_windows: int = 20
    hour_block_h: int = 1
    hour_block_fallback_h: int = 3
    min_level_windows: int = 10
    dispersion_p: float = 0.05
    alpha_lo: float = 1e-4
    alpha_hi: float = 50.0
    max_coef: float = 8.0
    phase1_q: float = 0.999
    phase1_iter: int = 3
    phase1_share: float = 0.01
    warning: float = 0.95
    action: float = 0.99
    strata_hour_h: int = 6
    strata_min: int = 30
    crosscheck_rel: float = 0.25
    max_disagreeing: float = 0.20
    pass95: tuple = (0.03, 0.07)
    pass99: tuple = (0.003, 0.02)
    min_months: int = 3
    stability_fractions: tuple = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
    stability_reps: int = 10
    plateau_tol: float = 0.05
    min_days: int = 28
    recommended_days: int = 90
    bootstrap_reps: int = 2000
    sweep_reps: int = 500
    seed: int = 20250101
    power_alpha: float = 0.05
    power_target: float = 0.80


@dc.dataclass(frozen=True)
class Probability:
    tau_step_s: int = 10
    sigma0_nm: float = 0.02
    sigma0_ft: float = 25.0
    mad_scale: float = 1.4826
    min_samples: int = 20
    bins: int = 10
    max_ece: float = 0.05
    disc_nodes: int = 48


@dc.dataclass(frozen=True)
class Detection:
    """Airport-profile detection from a sample of days."""

    max_days: int = 5
    final_radius_nm: float = 4.0
    final_height_ft: tuple = (200.0, 1500.0)
    final_max_vrate_fpm: float = -300.0
    min_samples: int = 200
    air_carrier_gs_kt: float = 100.0
    leg_gap_s: int = 1200
    end_radius_nm: float = 3.0
    end_height_ft: float = 1000.0
    end_lookback_s: int = 120
    min_legs: int = 10
    ground_share: float = 0.5
    floor_percentile: float = 0.90
    floor_margin_ft: float = 100.0
    floor_cap_ft: float = 1200.0


CLEANING = Cleaning()
VOLUME = Volume()
ENCOUNTER = Encounter()
GEOMETRY = Geometry()
APPROACH = Approach()
WINDOWS = Windows()
BASELINE = Baseline()
PROBABILITY = Probability()
DETECTION = Detection()


@dc.dataclass(frozen=True)
class Spec:
    """One analysis setting: nominal volume, lookahead and tiers."""

    radius_nm: float = VOLUME.radius_nm
    ceiling_ft: float = 4000.0
    lookahead_s: float = ENCOUNTER.lookahead_s
    tiers: tuple = TIERS
    merge_gap_s: int = ENCOUNTER.merge_gap_s
    exclude_procedural: bool = False

    @property
    def extended_ceiling_ft(self) -> float:
        return self.ceiling_ft + VOLUME.ceiling_buffer_ft

    def scaled(self, tier: str, which: str, factor: float) -> "Spec":
        """The same setting with one limit of one tier multiplied."""
        tiers = tuple(
            (n, h * factor if n == tier and which == "H" else h,
             v * factor if n == tier and which == "V" else v)
            for n, h, v in self.tiers
        )
        return dc.replace(self, tiers=tiers)


@dc.dataclass(frozen=True)
class Airport:
    """Reference point, elevation and runway ends of one airport.

    ``runways`` holds (name, threshold x NM, threshold y NM, bearing deg) in
    the local plane; ``flows`` maps a runway end to its flow label.
    """

    icao: str
    latitude: float
    longitude: float
    elevation_ft: float
    timezone: str
    runways: tuple = ()
    flows: tuple = ()
