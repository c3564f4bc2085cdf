"""Parameters of the price pipeline."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    commodities: tuple[str, ...] = ("Tomato", "Onion", "Potato")
    look_alikes: tuple[str, ...] = ("Onion Green", "Sweet Potato")
    states: tuple[str, ...] = ()  #: empty for all
    start: str = "2018-01-01"
    main_end: str = "2025-10-31"
    period: str = "main"
    price_min: float = 50.0
    price_max: float = 20000.0
    outlier_log_ratio: float = 1.0986
    outlier_days: int = 30
    outlier_min_obs: int = 5
    outlier_min_markets: int = 3
    outlier_rule: str = "temporal_and_cross_section"
    zero_bounds_missing: bool = True
    low_log_ratio: float = 1.0986
    low_min_rows: int = 30
    low_min_share: float = 0.10
    include_suspect_low: bool = False
    road_factor: float = 1.3
    max_pair_km: float = 150.0
    spread_km: float = 100.0
    near_km: float = 50.0
    drop_horizon: int = 14
    drop_lookback: int = 30
    drop_min_obs: int = 5
    drop_ratio: float = 0.7
    drop_min_days: int = 2
    year_min_days: int = 60
    series_min_days: int = 180
    thin_towns: int = 2
    low_index: float = 0.9
    fill_days: int = 3
    horizon: int = 7
    #: name: (cost per km, fixed cost, share of the destination's price)
    scenarios: dict[str, tuple[float, float, float]] = field(default_factory=lambda: {"low": (1.0, 30.0, 0.04), "mid": (1.5, 50.0, 0.06), "high": (2.5, 80.0, 0.08)})
    gain_min: float = 100.0
    gain_min_share: float = 0.05

    def __post_init__(self) -> None:
        if self.outlier_rule not in ("temporal", "temporal_and_cross_section"):
            raise ValueError(f"unknown outlier_rule: {self.outlier_rule}")
        if set(self.commodities) & set(self.look_alikes):
            raise ValueError("a commodity is also listed as a look-alike")
