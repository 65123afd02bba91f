"""Parameters of the analyses. Fixed values that must agree with published settings stand together here."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Accumulation days, baseline events, sensitivity grids, seasons, windows.
SPI_SCALES = (5, 30, 90)
AIC_SWITCH_THRESHOLD = 2.0
BURN_IN_DAYS = 365
MIN_EVENTS = 3
N_SURROGATES = 1000
SURROGATE_QUANTILE = 0.95
BC_SAMPLE_K = 1000
BASELINE = {
    5: {"kind": "rapid", "threshold": -2.5, "development_days": 15, "final_threshold": -1.0, "tau": 15},
    30: {"kind": "regular", "threshold": -1.0, "duration": 30, "tau": 30},
    90: {"kind": "regular", "threshold": -1.0, "duration": 90, "tau": 90},
}
THRESHOLD_SENSITIVITY = {5: (-2.0, -2.5, -3.0), 30: (-0.5, -1.0, -1.5), 90: (-0.5, -1.0, -1.5)}
TAU_SENSITIVITY = {5: (10, 15, 20), 30: (15, 30, 45), 90: (60, 90, 120)}
SEASONS = {"annual": None, "spring": (3, 4, 5), "summer": (6, 7, 8), "autumn": (9, 10, 11), "winter": (12, 1, 2)}
MIN_CLUSTER_FRACTION, MIN_TOTAL_FRACTION, MIN_FLUX_RATIO = 0.001, 0.01, 0.60
GI_Z, GI_P = 1.96, 0.05
COMPOSITE_SEASONS = {5: ("spring", "summer", "autumn", "winter"), 30: ("autumn", "winter"), 90: ("autumn", "winter")}
LEAD_LAG_WINDOWS = {5: (-15, 30), 30: (-30, 60), 90: (-90, 180)}
SMOOTHING_WINDOWS = {5: 3, 30: 15, 90: 45}
EARTH_RADIUS_KM = 6371.0


@dataclass(frozen=True)
class Fixture:
    """Settings that suit the small driver tables: denser events than the baseline."""

    scale: int = 30
    threshold: float = -1.0
    duration: int = 5
    tau: int = 15
    rapid_days: int = 15
    rapid_change: float = -1.5
    rapid_final: float = -1.0
    surrogates: int = N_SURROGATES
    lags: tuple[int, int] = (-30, 60)
    smoothing: int = 15
    hot_z: float = 1.0
    cluster_fraction: float = 0.005
    flux_ratio: float = 0.3
    seasons: dict = field(default_factory=lambda: dict(SEASONS))


FIXTURE = Fixture()
