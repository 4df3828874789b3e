"""Parameters of the operators as frozen dataclasses."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace

#: severities from best to worst; the position is the rank
SEVERITIES = ("ok", "warn", "alert")

#: calendar features, in the order of the design (fixed values)
CALENDAR = ("hour", "dayofweek", "month", "is_weekend", "is_holiday")
CATEGORICAL = ("hour", "dayofweek", "month")
#: known ahead of time, so they are reported but never vote
DETERMINISTIC = ("horizon_h", *CALENDAR)

#: panel column -> feature read at the target hour once published (fixed values)
FORECAST_SOURCES = {
    "fcst_temperature_c": "temp_fcst_target",
    "fcst_temperature_spread_c": "temp_fcst_spread_target",
    "fcst_humidity_pct": "humidity_fcst_target",
    "fcst_dewpoint_c": "dewpoint_fcst_target",
    "fcst_wind_kmh": "wind_fcst_target",
    "fcst_cloud_pct": "cloud_fcst_target",
}


@dataclass(frozen=True)
class TableSpec:
    """A keyed table of measurements, partitioned by the year and month of its time."""

    name: str
    keys: tuple[str, ...]
    time_col: str
    path: str


@dataclass(frozen=True)
class SeriesSpec:
    """Step, lags and windows of a series, all in hours."""

    step: int = 1
    lags: tuple[int, ...] = (24, 48, 168, 336)
    temperature_lag: int = 168
    season_lags: tuple[int, ...] = (168, 336, 504, 672)
    short_window: int = 24
    long_window: int = 168
    season: int = 168
    min_history: int = 672
    max_horizon: int = 24
    stride: int = 6
    cutoff_hour: int = 12
    published_hour: int = 12
    timezone: str = "America/New_York"

    @property
    def horizons(self) -> tuple[int, ...]:
        return tuple(range(self.step, self.max_horizon + 1, self.step))

    @property
    def features(self) -> tuple[str, ...]:
        """Feature columns in order (fixed values); with the defaults there are 27 besides the repeated horizon."""
        return (
            "horizon_h",
            *CALENDAR,
            *(f"demand_lag_{k}h" for k in self.lags),
            "demand_same_season_mean",
            "demand_last",
            "demand_roll_mean_short",
            "demand_roll_std_short",
            "demand_roll_min_short",
            "demand_roll_max_short",
            "demand_roll_mean_long",
            "temp_lag",
            "temp_last",
            "temp_roll_mean_short",
            *FORECAST_SOURCES.values(),
            "temp_fcst_minus_lag",
        )


@dataclass(frozen=True)
class Thresholds:
    """Alarm lines of the drift detectors (defaults are fixed values); values at a line count as over it."""

    psi_warn: float = 0.10
    psi_alert: float = 0.20
    ks_p_alert: float = 0.01
    psi_bins: int = 10
    max_categorical_levels: int = 24
    min_samples: int = 200
    drifted_share_warn: float = 0.15
    drifted_share_alert: float = 0.30
    mae_degradation_warn: float = 0.15
    mae_degradation_alert: float = 0.30
    mape_degradation_warn_pp: float = 0.50
    mape_degradation_alert_pp: float = 1.00
    rolling_window_hours: int = 168

    @classmethod
    def from_conf(cls, conf: dict[str, str] | None = None, prefix: str = "DRIFT_") -> Thresholds:
        """Defaults with overrides such as ``DRIFT_PSI_WARN``, from the environment unless ``conf`` is given."""
        conf = dict(os.environ) if conf is None else conf
        found = {f.name: conf.get(prefix + f.name.upper(), "").strip() for f in fields(cls)}
        kinds = {f.name: type(f.default) for f in fields(cls)}
        return replace(cls(), **{k: kinds[k](v) for k, v in found.items() if v})


@dataclass(frozen=True)
class WindowSpec:
    """Lengths of the reference and current windows, and of the step between origins."""

    reference_days: int = 14
    current_days: int = 14
    stride: int = 6
