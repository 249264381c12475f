"""Named settings of selection and regime tuning, and utility weights from costs and constraints."""

from __future__ import annotations

#: Selection constraints by name (no entry: no constraint).
SELECTION = {
    "aggressive": {},
    "low_redundancy": {"max_pairwise_corr": 0.35},
    "low_cost": {"max_total_cost_bps": 8.0},
    "stable_generalization": {"min_valid_ir": 0.10, "min_valid_coverage": 0.60},
}
#: Regime tuning by name: constraints, turnover cost, how the row is chosen, utility weights.
REGIME_TUNING = {
    "aggressive": {"constraints": {}, "turnover_cost_bps": 0.0, "prefer_pareto": False, "method": "best", "weights": {}},
    "low_turnover": {"constraints": {"max_alpha_weight_turnover_mean": 0.25, "max_regime_switch_rate_mean": 0.15, "max_turnover_cost_drag_bps_mean": 7.5}, "turnover_cost_bps": 0.2, "prefer_pareto": True, "method": "knee", "weights": {}},
    "execution_realistic": {"constraints": {"max_alpha_weight_turnover_mean": 0.35, "max_turnover_cost_drag_bps_mean": 10.0, "max_regime_switch_rate_mean": 0.20, "max_fallback_frac_mean": 0.25}, "turnover_cost_bps": 0.2, "prefer_pareto": True, "method": "utility",
                            "weights": {"objective": 1.0, "holdings_objective": 1.0, "alpha_weight_turnover_mean": 0.4, "turnover_cost_drag_bps_mean": 0.4, "regime_switch_rate_mean": 0.2, "fallback_frac_mean": 0.2, "objective_split_std": 0.2, "objective_split_min": 0.2, "holdings_objective_split_std": 0.2, "holdings_objective_split_min": 0.2, "ensemble_cost_mean": 0.2, "ensemble_borrow_mean": 0.2}},
}
#: Metric -> (weight at the usual cost, does it scale with cost, extra weight under a constraint of its own).
UTILITY = {
    "objective": (1.0, False, 0.0), "holdings_objective": (1.0, False, 0.0),
    "alpha_weight_turnover_mean": (0.25, True, 0.25), "turnover_cost_drag_bps_mean": (0.25, True, 0.25),
    "regime_switch_rate_mean": (0.15, False, 0.15), "fallback_frac_mean": (0.15, False, 0.15),
    "ensemble_turnover_mean": (0.20, True, 0.0), "ensemble_cost_mean": (0.20, True, 0.0), "ensemble_borrow_mean": (0.10, True, 0.0),
}
#: Other names of the regime tuning presets.
ALIASES = {"fast": "aggressive", "low-turnover": "low_turnover", "stable": "low_turnover", "execution": "execution_realistic", "realistic": "execution_realistic"}
#: Metrics that a preset's Pareto front looks at besides the objective.
PARETO_METRICS = {"aggressive": [], "low_turnover": ["turnover_cost_drag_bps_mean", "regime_switch_rate_mean"], "execution_realistic": ["turnover_cost_drag_bps_mean", "regime_switch_rate_mean", "fallback_frac_mean", "ensemble_cost_mean", "ensemble_borrow_mean"]}
STABILITY = ("objective_split_std", "objective_split_min", "holdings_objective_split_std", "holdings_objective_split_min")
USUAL_COST_BPS, COST_SCALE = 0.2, (0.5, 2.5)


def regime_preset(name: str | None) -> dict | None:
    """The regime tuning preset of a name or an alias, in any case; None for unknown names."""
    key = (name or "").strip().lower()
    key = ALIASES.get(key, key)
    return REGIME_TUNING[key] | {"name": key, "pareto_metrics": PARETO_METRICS[key]} if key in REGIME_TUNING else None


def merge(*parts: dict | None) -> dict:
    """Constraints in one; later ones win, missing values don't count."""
    return {k: v for p in parts for k, v in (p or {}).items() if v is not None}


def utility_weights(turnover_cost_bps: float, constraints: dict | None = None, stability: bool = True) -> dict[str, float]:
    """Weights of the utility choice: costs weigh more where trading is dear, constrained metrics more than others."""
    bps = max(turnover_cost_bps or 0.0, 0.0)
    scale = min(max(bps / USUAL_COST_BPS, COST_SCALE[0]), COST_SCALE[1]) if bps else 1.0
    limits = merge(constraints)
    out = {m: w * (scale if scaled else 1.0) + (extra if f"max_{m}" in limits else 0.0) for m, (w, scaled, extra) in UTILITY.items()}
    return out | dict.fromkeys(STABILITY, 0.2 if stability else 0.0)
