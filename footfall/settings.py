"""Settings of a site's analytics, with the bounds they must keep."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

#: Smallest and largest value of each bounded setting.
BOUNDS = {
    "hll_precision": (11, 14),
    "session_window": (60, 14_400),
    "hourly_window_days": (1, 90),
    "dimension_cap": (10, 100_000),
    "retention_months": (1, 26),
    "journey_retention_days": (1, 790),
    "consent_retention_days": (0, 3_650),
    "beacon_rate_limit": (1, 10_000),
    "nonce_ttl": (60, 86_400),
    "salt_rotation_hour": (0, 23),
}


@dataclass(frozen=True)
class Settings:
    timezone: str = "UTC"
    unique_counter: str = "exact"
    hll_precision: int = 12
    session_window: int = 1_800
    hourly_window_days: int = 7
    dimension_cap: int = 1_000
    retention_months: int = 26
    journey_retention_days: int = 90
    consent_retention_days: int = 0
    beacon_rate_limit: int = 120
    nonce_ttl: int = 1_800
    salt_rotation_interval: int = 86_400
    salt_rotation_hour: int = 4
    attribution: str = "last-click"
    enable_pro: bool = True
    enable_geo: bool = True
    enable_journeys: bool = False
    honour_gpc: bool = True
    honour_dnt: bool = False
    strip_query: bool = False
    hybrid: bool = False
    exclude_params: tuple[str, ...] = ()
    exclude_paths: tuple[str, ...] = ()
    exclude_sections: tuple[int, ...] = ()
    own_hosts: tuple[str, ...] = ()
    search_path: str = "/search"
    search_param: str = "q"
    bot_score_threshold: int = 30
    segments: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        for name, (low, high) in BOUNDS.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be between {low} and {high}")
        if self.unique_counter not in ("exact", "hll", "bitmap"):
            raise ValueError("unique_counter must be exact, hll or bitmap")
        if self.attribution not in ("last-click", "first-click", "linear"):
            raise ValueError("attribution must be last-click, first-click or linear")

    @classmethod
    def named(cls, **values: object) -> Settings:
        unknown = set(values) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**values)
