"""Optimized long/short weights of one cross-section: a quadratic program with a ridge fallback.

Everything here is NumPy over the candidates of one date; ``portfolio.stepwise`` calls it for each
rebalance.  Arrays are aligned: scores, side (1 long, -1 short), the weights that are held or wanted
before (``target``), exposures (names x exposures) and costs by name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Optimizer:
    """Penalties, limits and the backend: "auto" and "qp" try the quadratic program first, "ridge" does not."""

    backend: str = "auto"
    l2: float = 1.0
    turnover: float = 0.0
    exposure: float = 0.0
    risk: float = 0.0
    cost: float = 1.0
    iterations: int = 5
    turnover_cap: float = 0.0
    participation: bool = True
    #: Exposures are held at zero in the quadratic program, or pulled there by this penalty.
    neutral: bool = False
    slack: float = 0.0
    gross_long: float = 0.5
    gross_short: float = 0.5


def standardized(x: np.ndarray, ddof: int = 1) -> np.ndarray:
    """Columns with missing values as their median, mean zero and deviation one (a constant column: zeros)."""
    x = np.where(np.isfinite(x), x, np.nan)
    out = np.zeros(x.shape)
    for j in range(x.shape[1]):
        c = x[:, j]
        c = np.where(np.isnan(c), np.nanmedian(c) if np.isfinite(c).any() else 0.0, c)
        sd = c.std(ddof=ddof) if len(c) > ddof else 0.0
        out[:, j] = (c - c.mean()) / (sd if np.isfinite(sd) and sd > 1e-12 else 1.0)
    return out


def filled(x: np.ndarray | None, n: int) -> np.ndarray:
    """Non-negative values, missing ones as the median of the others (all missing: zero)."""
    if x is None:
        return np.zeros(n)
    x = np.where(np.isfinite(x), x, np.nan)
    return np.maximum(np.where(np.isnan(x), np.nanmedian(x) if np.isfinite(x).any() else 0.0, x), 0.0)


def factor_part(model: dict | None, risk: float) -> np.ndarray | None:
    """A with A A' = risk * B F B' of a factor risk model."""
    if model is None or risk <= 0:
        return None
    values, vectors = np.linalg.eigh((model["factor_cov"] + model["factor_cov"].T) / 2)
    return risk**0.5 * model["loadings"] @ (vectors * np.sqrt(np.maximum(values, 0.0)))


def precheck(side: np.ndarray, target: np.ndarray, opt: Optimizer, most: float = 0.0, most_trade: np.ndarray | None = None, n_exposures: int = 0) -> dict:
    """Reasons why no weights can meet all limits, and what would help; it proves failure, never success."""
    reasons, suggestions, warnings = [], [], []

    def fail(reason: str, parameter: str, message: str, **more) -> None:
        reasons.append(reason)
        suggestions.append({"parameter": parameter, "message": message, **more})

    n = {1: int((side > 0).sum()), -1: int((side < 0).sum())}
    gross = {1: opt.gross_long, -1: opt.gross_short}
    if len(side) < 4:
        fail("too_few_names", "candidate_set", "more candidates: larger sides or fewer quantiles")
    need = max(gross[s] / max(n[s], 1) for s in n)
    for s, name in ((1, "long"), (-1, "short")):
        if most > 0 and n[s] * most + 1e-12 < gross[s]:
            fail(f"cap_{name}_too_tight", "max_abs_weight", "a larger weight cap, or more names", suggested_min=need)
    # at least this much must change for the signs and the sums of both sides
    wrong = np.maximum(-target * side, 0.0).sum()
    least = (wrong + sum(abs(gross[s] - np.maximum(target * s, 0.0)[side == s].sum()) for s in n)) / 2
    if opt.turnover_cap > 0 and least > opt.turnover_cap + 1e-9:
        fail("turnover_cap_too_small", "optimizer_turnover_cap", "a larger turnover cap", suggested_min=float(least))
    reach = {}
    if most_trade is not None:
        bound = np.where(np.isfinite(most_trade), np.maximum(most_trade, 0.0), 1e9)
        if least > bound.sum() / 2 + 1e-9:
            fail("trade_bounds_too_tight_for_required_change", "optimizer_enforce_participation", "no participation bounds, or larger ones", suggested=False)
        cap = most if most > 0 else np.inf
        for s, name in ((1, "long"), (-1, "short")):
            own = side == s
            lo, hi = np.maximum(s * target[own] - bound[own], 0.0).sum(), np.minimum(s * target[own] + bound[own], cap).sum()
            reach[f"reachable_{name}"] = [float(lo), float(hi)]
            if gross[s] < lo - 1e-9 or gross[s] > hi + 1e-9:
                fail(f"gross_{name}_unreachable_under_trade_bounds", "impact_max_participation", "larger participation, or a smaller portfolio")
    if opt.neutral and not opt.slack and n_exposures and len(side) - 2 - n_exposures <= 0:
        warnings.append("very_low_dof_for_hard_neutrality")
        suggestions.append({"parameter": "optimizer_exposure_slack_lambda", "message": "a penalty instead of hard neutrality", "suggested_min": 1.0})
    return {"passed": not reasons, "reasons": reasons, "warnings": warnings, "suggestions": suggestions, "n_long": n[1], "n_short": n[-1], "turnover_lb_to_meet_gross": float(least), **reach}


def cost_aware(scores: np.ndarray, side: np.ndarray, aversion: float, costs: dict) -> np.ndarray:
    """Scores shrunk where trading is dear, and raised (towards no short) where borrowing is."""
    if aversion <= 0:
        return scores
    trade = np.maximum(np.nan_to_num(costs.get("trade", np.zeros(len(scores)))), 0.0)
    borrow = np.nan_to_num(costs.get("borrow", np.zeros(len(scores))))
    return scores / (1 + aversion * trade) + aversion * np.where(side < 0, borrow, 0.0)


def ridge(scores: np.ndarray, side: np.ndarray, target: np.ndarray, x: np.ndarray, opt: Optimizer, most: float = 0.0, variance: np.ndarray | None = None, model: dict | None = None) -> np.ndarray | None:
    """(D + A A') w = scores + turnover * target by the Woodbury identity, then signs, sums of sides and the cap."""
    n = len(scores)
    low_rank = factor_part(model, opt.risk)
    d = np.full(n, max(opt.l2 + opt.turnover, 1e-12))
    if opt.risk > 0:
        d = d + opt.risk * filled(model["specific"] if model is not None else variance, n)
    parts = [p for p in (opt.exposure**0.5 * standardized(x) if x.size and opt.exposure > 0 else None, low_rank) if p is not None]
    w = (np.nan_to_num(scores) + opt.turnover * target) / d
    if parts:
        a = np.concatenate(parts, axis=1)
        w = w - (a / d[:, None]) @ np.linalg.solve(np.eye(a.shape[1]) + a.T @ (a / d[:, None]), a.T @ w)
    for _ in range(max(opt.iterations, 1)):
        w = _sides(_summed(_sides(w, side), opt, True), side)
        if most > 0:
            w = _summed(np.clip(w, -most, most), opt, False)
    return w if (w > 0).any() and (w < 0).any() else None


def ridge_weights(scores: np.ndarray, exposures: np.ndarray, variances: np.ndarray, side: np.ndarray, most: float = 0.0, **settings) -> np.ndarray | None:
    """Ridge weights without a book to start from, on centred scores; variances as a risk penalty."""
    opt = Optimizer(**({"backend": "ridge", "l2": 1e-3, "exposure": 1.0, "risk": 1.0} | settings))
    return ridge(scores - scores.mean(), side, np.zeros(len(scores)), exposures, opt, most, variances)


def feasible(n_long: int, n_short: int, most: float, min_names: int = 1) -> dict:
    """Whether two sides of one half fit under the cap, and the least cap that would do."""
    need = max(0.5 / max(n_long, 1), 0.5 / max(n_short, 1))
    return {"feasible": most >= need and min(n_long, n_short) >= min_names, "suggested_max_weight": need}


def _sides(w: np.ndarray, side: np.ndarray) -> np.ndarray:
    return np.where(side > 0, np.maximum(w, 0.0), np.minimum(w, 0.0))


def _summed(w: np.ndarray, opt: Optimizer, scale_up: bool) -> np.ndarray:
    out = w.copy()
    for s, gross in ((1, opt.gross_long), (-1, opt.gross_short)):
        own = w * s > 0
        total = np.abs(w[own]).sum()
        if total > 0 and (scale_up or total > gross):
            out[own] *= gross / total
    return out


def trade_limits(w: np.ndarray, side: np.ndarray, target: np.ndarray, opt: Optimizer, most: float = 0.0, most_trade: np.ndarray | None = None) -> tuple[np.ndarray, dict]:
    """Weights moved from ``target`` no further than the trade bounds and the turnover cap allow, with signs, sums and the cap kept from above."""
    meta = {}
    move = w - target
    if most_trade is not None and np.isfinite(most_trade).any():
        move = np.sign(move) * np.minimum(np.abs(move), np.where(np.isfinite(most_trade), np.maximum(most_trade, 0.0), np.inf))
        meta["trade_bounds_applied"] = True
    turnover = np.abs(move).sum() / 2
    if opt.turnover_cap > 0 and turnover > opt.turnover_cap + 1e-12:
        move *= opt.turnover_cap / turnover
        meta |= {"turnover_cap_applied": True, "turnover_scale": float(opt.turnover_cap / turnover)}
    w = _summed(_sides(target + move, side), opt, False)
    if most > 0:
        w = _summed(np.clip(w, -most, most), opt, False)
    return w, meta | {"turnover_to_target": float(np.abs(w - target).sum() / 2), "gross_long": float(w[w > 0].sum()), "gross_short": float(-w[w < 0].sum())}


#: How far a solution may be from a limit.
VIOLATION = 1e-9


def _excess(a: np.ndarray, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> float:
    """The largest distance of Ax from its limits."""
    ax = a @ x
    return float(max(np.max(low - ax, initial=0.0), np.max(ax - high, initial=0.0)))


def _polished(p: np.ndarray, q: np.ndarray, a: np.ndarray, low: np.ndarray, high: np.ndarray, z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least value with the limits that bind at (z, y) as equations."""
    at_low, at_high = z - low < -y, high - z < y
    some = at_low | at_high
    b = np.where(at_low, low, high)[some]
    active, m = a[some], int(some.sum())
    system = np.block([[p, active.T], [active, np.zeros((m, m))]])
    return np.linalg.lstsq(system, np.concatenate([-q, b]), rcond=1e-12)[0][: len(q)]


def solve_qp(p: np.ndarray, q: np.ndarray, a: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int = 8000, tol: float = 1e-7) -> tuple[np.ndarray | None, float]:
    """The x of least x'Px / 2 + q'x with low <= Ax <= high, and its largest distance from the limits.

    Operator splitting finds which limits bind; the equations of these then give the point itself.
    Only a point that keeps all limits to ``VIOLATION``, and that is no worse than the iterate, is a
    solution; without one x is None, and the distance that of the last point.
    """
    n, sigma = len(q), 1e-6
    value = lambda v: float(v @ p @ v / 2 + q @ v)
    rho = np.where(low == high, 100.0, 0.1)
    x, z, y, excess = np.zeros(n), np.zeros(len(low)), np.zeros(len(low)), np.inf
    for _ in range(16):
        inverse = np.linalg.inv(p + sigma * np.eye(n) + a.T @ (rho[:, None] * a))
        for _ in range(steps // 16):
            x = inverse @ (sigma * x - q + a.T @ (rho * z - y))
            ax = a @ x
            z = np.clip(ax + y / rho, low, high)
            y = y + rho * (ax - z)
            primal, dual = np.abs(ax - z).max(), np.abs(p @ x + q + a.T @ y).max()
            if primal < tol and dual < tol * 10:
                break
        excess = _excess(a, x, low, high)
        if primal < 1e-3 and dual < 1e-2:
            exact = _polished(p, q, a, low, high, z, y)
            if _excess(a, exact, low, high) <= VIOLATION and value(exact) <= value(x) + 1e-4 * (1 + abs(value(x))):
                return exact, _excess(a, exact, low, high)
            if primal < tol and dual < tol * 10:
                if excess <= VIOLATION:
                    return x, excess
                tol /= 10
        rho = rho * min(max((primal / max(dual, 1e-12)) ** 0.5, 0.1), 10.0)
    return None, excess


def quadratic(scores: np.ndarray, side: np.ndarray, target: np.ndarray, x: np.ndarray, opt: Optimizer, most: float, costs: dict, model: dict | None = None) -> tuple[np.ndarray | None, float]:
    """The constrained problem over weights and the absolute trades: sums of sides, cap, trade bounds, turnover and neutrality hold; and the distance from them."""
    n, lists = len(scores), []
    z = standardized(x) if x.size else np.zeros((n, 0))
    quad = np.eye(n) * 2 * max(opt.l2, 1e-8)
    if opt.risk > 0:
        low_rank = factor_part(model, opt.risk)
        quad += np.diag(2 * opt.risk * filled(model["specific"] if model is not None else costs.get("variance"), n))
        quad += 0 if low_rank is None else 2 * low_rank @ low_rank.T
    pull = opt.slack if opt.neutral and opt.slack else opt.exposure if not opt.neutral else 0.0
    if z.size and pull:
        quad += 2 * pull * z @ z.T
    trade = opt.turnover + opt.cost * filled(costs.get("trade"), n)
    linear = -np.nan_to_num(scores) - opt.cost * np.where(side < 0, filled(costs.get("borrow"), n), 0.0)
    p = np.zeros((2 * n, 2 * n))
    p[:n, :n] = quad
    q = np.concatenate([linear, trade])
    eye, zero, one = np.eye(n), np.zeros((n, n)), np.ones(n)
    cap = most if most > 0 else np.inf

    def need(left, right, low, high):
        lists.append((np.concatenate([np.atleast_2d(left), np.atleast_2d(right)], axis=1), np.atleast_1d(low), np.atleast_1d(high)))

    need(side > 0, 0 * one, opt.gross_long, opt.gross_long)
    need(side < 0, 0 * one, -opt.gross_short, -opt.gross_short)
    need(eye, zero, np.where(side > 0, 0.0, -cap), np.where(side > 0, cap, 0.0))
    need(eye, -eye, np.full(n, -np.inf), target)
    need(eye, eye, target, np.full(n, np.inf))
    bound = costs.get("most_trade") if opt.participation else None
    need(zero, eye, np.zeros(n), np.where(np.isfinite(bound), bound, np.inf) if bound is not None else np.full(n, np.inf))
    if opt.turnover_cap > 0:
        need(0 * one, one, 0.0, 2 * opt.turnover_cap)
    if opt.neutral and not opt.slack and z.size:
        need(z.T, 0 * z.T, np.zeros(z.shape[1]), np.zeros(z.shape[1]))
    a, low, high = (np.concatenate(c).astype(float) for c in zip(*lists))
    got, excess = solve_qp(p, q, a, low, high)
    return None if got is None else _sides(got[:n], side), excess


def constraint_summary(w: np.ndarray, target: np.ndarray, x: np.ndarray, opt: Optimizer, most: float = 0.0, most_trade: np.ndarray | None = None) -> dict:
    """How far each limit is used, and which bind."""
    move = np.abs(w - target)
    turnover = float(move.sum() / 2)
    long, short = float(np.maximum(w, 0).sum()), float(np.maximum(-w, 0).sum())
    out = {"gross": {"gross_long": long, "gross_short": short, "gross_long_resid": long - opt.gross_long, "gross_short_resid": short - opt.gross_short},
           "turnover": {"turnover_to_target": turnover, "turnover_cap": opt.turnover_cap, "binding": opt.turnover_cap > 0 and turnover >= 0.99 * opt.turnover_cap},
           "max_abs_weight": {"cap": most, "enabled": most > 0, "binding": False}, "participation": {"enabled": most_trade is not None, "binding": False}, "exposure": {"enabled": bool(x.size)}}
    size = np.abs(w)
    if most > 0 and len(w):
        out["max_abs_weight"] |= {"max_used": float(size.max()), "at_cap_frac": float((size >= 0.999 * most).mean()), "binding": bool(size.max() >= 0.99 * most)}
    if most_trade is not None and len(w):
        bound = np.where(np.isfinite(most_trade), np.maximum(most_trade, 0.0), np.inf)
        used = np.where(bound > 0, move / np.where(bound > 0, bound, 1.0), 0.0)
        out["participation"] |= {"max_ratio": float(used.max()), "binding_frac": float((used >= 0.999).mean()), "violation_max": float((move - bound).max()), "binding": bool(used.max() >= 0.99)}
    if x.size:
        e = standardized(x).T @ w
        out["exposure"] |= {"max_abs": float(np.abs(e).max()), "l2": float((e * e).sum() ** 0.5)}
    names = {"turnover": "turnover_cap", "max_abs_weight": "max_abs_weight", "participation": "participation_cap"}
    return out | {"binding_constraints": [names[k] for k in names if out[k]["binding"]]}


def optimize(scores: np.ndarray, side: np.ndarray, target: np.ndarray, x: np.ndarray, opt: Optimizer, most: float = 0.0, costs: dict | None = None, model: dict | None = None) -> tuple[np.ndarray | None, dict]:
    """Weights and diagnostics: the quadratic program where it is wanted and possible, else ridge with trade limits.

    No weights (None) where a side is empty or comes out empty.
    """
    costs, meta = costs or {}, {"backend_requested": opt.backend, "backend_used": "ridge", "fallback": None}
    if not (side > 0).any() or not (side < 0).any() or not np.isfinite(scores).any():
        return None, meta
    bound = costs.get("most_trade") if opt.participation else None
    w = None
    if opt.backend in ("auto", "qp"):
        meta["qp_precheck"] = check = precheck(side, target, opt, most, bound, x.shape[1])
        if not check["passed"]:
            meta["fallback"] = "qp_precheck_failed:" + ",".join(check["reasons"][:2])
        else:
            w, meta["qp_violation"] = quadratic(scores, side, target, x, opt, most, costs, model)
            meta |= {"backend_used": "qp"} if w is not None else {"fallback": "qp_failed:unconverged"}
    if w is None:
        adjusted = cost_aware(np.nan_to_num(scores), side, opt.cost, costs)
        w = ridge(adjusted, side, target, x, opt, most, costs.get("variance"), model)
        if w is None:
            return None, meta
        w, meta["ridge_limits"] = trade_limits(w, side, target, opt, most, bound)
    move = np.abs(w - target)
    terms = {"alpha_score": float(np.nan_to_num(scores) @ w), "l2": float(opt.l2 * (w * w).sum()), "turnover_l1": float(opt.turnover * move.sum())}
    if x.size and opt.exposure:
        terms["exposure_penalty"] = float(opt.exposure * ((standardized(x).T @ w) ** 2).sum())
    if opt.risk > 0:
        specific = float(filled(model["specific"] if model is not None else costs.get("variance"), len(w)) @ (w * w))
        y = model["loadings"].T @ w if model is not None else np.zeros(0)
        common = float(y @ model["factor_cov"] @ y) if model is not None else 0.0
        terms |= {"factor_risk": opt.risk * common, "idio_risk": opt.risk * specific}
        meta["risk"] = {"risk_model": "factor" if model is not None else "diag", "risk_proxy": common + specific, "risk_vol_annual_proxy": max(common + specific, 0.0) ** 0.5}
    if opt.cost > 0:
        terms |= {"trade_cost": float(opt.cost * filled(costs.get("trade"), len(w)) @ move), "borrow_cost": float(opt.cost * filled(costs.get("borrow"), len(w)) @ np.maximum(-w, 0))}
    meta["diagnostics"] = {"n_long": int((side > 0).sum()), "n_short": int((side < 0).sum()), "turnover_to_target": float(move.sum() / 2), "objective_terms": terms, "constraint_summary": constraint_summary(w, target, x, opt, most, bound)}
    return w, meta


def factor_risk_model(returns: np.ndarray, loadings: np.ndarray, window: int = 0, min_obs: int = 2, ridge_: float = 1e-3, shrink: float = 0.2, method: str = "fixed", estimator: str = "sample", halflife: float = 20.0, clip_sigma: float = 6.0, specific_shrink: float = 0.2, specific_clip: float = 0.99, days: int = 252) -> dict | None:
    """B F B' + D, annualized, from a window of returns (dates x names) and loadings (names x factors); None with too few of either.

    Loadings are standardized; daily factor returns are ridge regressions, clipped at ``clip_sigma``
    deviations; their covariance (plain, or weighted in time with a half-life) is shrunk to its
    diagonal (``fixed``) or to a scaled identity (``oas``, by its rule) and made positive; residual
    variances are clipped at a quantile and shrunk to their median.
    """
    r = np.nan_to_num(np.where(np.isfinite(returns), returns, 0.0))
    r = r[-window:] if window else r
    if len(r) < max(min_obs, 2) or loadings.ndim != 2 or len(loadings) < 4 or not loadings.shape[1]:
        return None
    b = standardized(loadings, ddof=0)
    f = r @ b @ np.linalg.inv(b.T @ b + ridge_ * np.eye(b.shape[1]))
    if clip_sigma > 0:
        sd = f.std(axis=0)
        limit = np.where(sd > 1e-12, clip_sigma * sd, np.inf)
        f = np.clip(f, -limit, limit)
    weight = 0.5 ** (np.arange(len(f))[::-1] / max(halflife, 1e-6)) if estimator == "ewm" else np.ones(len(f))
    share = weight / weight.sum()
    centred = f - share @ f
    cov = (centred * share[:, None]).T @ centred
    effective = weight.sum() ** 2 / (weight**2).sum()
    if estimator != "ewm":
        cov = cov * len(f) / (len(f) - 1)
    used = shrink
    if method == "oas":
        p, trace, square = len(cov), np.trace(cov), (cov * cov).sum()
        bottom = (effective + 1 - 2 / p) * (square - trace * trace / p)
        used = float(np.clip(((1 - 2 / p) * square + trace * trace) / bottom, 0.0, 1.0)) if bottom > 1e-18 else 0.0
        cov = (1 - used) * cov + used * np.eye(p) * trace / p
    else:
        cov = (1 - shrink) * cov + shrink * np.diag(np.diag(cov))
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    cov = (vectors * np.maximum(values, 1e-12)) @ vectors.T * days
    d = np.maximum((r - f @ b.T).var(axis=0, ddof=1), 0.0) * days
    if 0 < specific_clip < 1 and np.quantile(d, specific_clip) > 0:
        d = np.minimum(d, np.quantile(d, specific_clip))
    d = (1 - specific_shrink) * d + specific_shrink * np.median(d)
    return {"loadings": b, "factor_cov": cov, "specific": d, "covariance": b @ cov @ b.T + np.diag(d), "shrinkage": used, "n_eff": float(effective)}
