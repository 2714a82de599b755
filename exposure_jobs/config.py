"""Settings of the jobs, passed in rather than global."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    horizons: tuple[int, ...] = tuple(range(1, 25))
    lag_hours: tuple[int, ...] = (1, 3, 6, 24, 48, 168)
    validation_weeks: int = 8
    test_weeks: int = 4
    display_timezone: str = "Europe/Kyiv"
    era_cutoff: str = "2025-12-01 00:00:00"
    outlier_days: int = 7
    calibration: str = "isotonic"
    baselines: tuple[str, ...] = field(default=("marginal", "seasonal", "persistence"))

    def __post_init__(self):
        if any(h < 1 for h in self.horizons) or any(k < 1 for k in self.lag_hours):
            raise ValueError("horizons and lags start at 1")
        if self.calibration not in ("isotonic", "sigmoid"):
            raise ValueError(f"unknown calibration {self.calibration!r}")
