"""Typed settings. The defaults are the values that take effect in practice."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class RiskConfig:
    # identity
    fuzzy_threshold: float = 85.0
    use_national_id: bool = True
    fuzzy_scorer: str = "token_sort_ratio"
    # matches an anchor may claim; None is all of them, 5 the compatible value
    fuzzy_limit: int | None = None
    # score weights
    rule_weight: float = 0.45
    anomaly_weight: float = 0.30
    supervised_weight: float = 0.25
    behavioral_bias: float = 0.0
    # risk bands
    critical: float = 85.0
    high: float = 65.0
    medium: float = 35.0
    # deterministic rules
    structuring_floor: float = 9000.0
    reporting_limit: float = 10000.0
    volume_multiplier: float = 2.0
    high_risk_jurisdictions: tuple[str, ...] = ("IR", "KP", "MM", "NG", "KY", "VE", "RU")
    # scenario typologies
    fan_in_limit: int = 10
    fan_out_limit: int = 10
    pass_through_ratio: float = 0.80
    u_turn_hours: int = 24
    high_risk_mccs: tuple[int, ...] = (5944, 6211)
    low_income_profiles: tuple[str, ...] = ("Student", "Unemployed")
    integration_ratio: float = 0.2
    # True keeps the 80 / 90 typology scores next to the behavioural z-score
    preserve_typology: bool = False
    # behaviour
    sigma: float = 3.0
    min_history: int = 3
    # graph
    min_edge_amount: float = 10000.0
    # "pagerank" or "degree", whatever the size
    importance: str = "pagerank"
    pagerank_iterations: int = 50
    resolve_receivers: bool = False
    # models
    contamination: float = 0.01
    forest_trees: int = 100
    # rows a tree is grown on and its depth: the method's own numbers
    forest_sample: int = 256
    forest_depth: int = 8
    boost_rounds: int = 100
    boost_depth: int = 6
    boost_rate: float = 0.1
    seed: int = 42
    # windowed rules
    hourly_limit: int = 5
    drain_ratio: float = 0.95
    drain_minutes: int = 30
    aggregation_count: int = 5
    aggregation_amount: float = 10000.0
    aggregation_hours: int = 24
    new_counterparty_amount: float = 5000.0
    dormant_days: int = 180
    baseline_days: int = 90

    def with_options(self, options: Mapping[str, object]) -> RiskConfig:
        """A copy with overrides; a key nobody reads is an error, not a silent no-op."""
        known = {f.name for f in fields(self)}
        unknown = sorted(set(options) - known)
        if unknown:
            raise KeyError(f"unknown settings: {', '.join(unknown)}")
        clean = {k: tuple(v) if isinstance(v, list) else v for k, v in options.items()}
        if 0 < float(clean.get("fuzzy_threshold", 100.0)) <= 1.0:
            clean["fuzzy_threshold"] = float(clean["fuzzy_threshold"]) * 100
        return replace(self, **clean)


def load_config(path: str | None = None) -> RiskConfig:
    """Settings from a flat YAML file of overrides; no path gives the defaults."""
    if path is None:
        return RiskConfig()
    import yaml

    with open(path) as handle:
        return RiskConfig().with_options(yaml.safe_load(handle) or {})
