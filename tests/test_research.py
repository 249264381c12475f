"""Optimizer, tuning, ensembles, reports, command line: against brute force, plain recursions and invariants."""

import itertools
import json
import os
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom import artifacts, cli, loop, plans, sources
from factorloom.operators import ensembles as ens
from factorloom.operators import optimizer as opt
from factorloom.operators import portfolio as pf
from factorloom.operators import presets, reporting, risk, tuning
from factorloom.operators import selection as sel
from factorloom.plans import safety


def case(n=12, seed=3):
    rng = np.random.default_rng(seed)
    score = np.sort(rng.normal(size=n))
    side = np.where(np.arange(n) >= n // 2, 1, -1)
    return score, side, np.zeros(n), rng.normal(size=(n, 2))


def test_ridge_solves_the_normal_equations():
    score, side, target, x = case()
    target = np.linspace(-0.1, 0.1, len(score))
    o = opt.Optimizer(backend="ridge", l2=0.7, turnover=0.4, exposure=2.0, risk=0.5)
    variance = np.linspace(0.1, 0.3, len(score))
    z = opt.standardized(x)
    d = np.diag(0.7 + 0.4 + 0.5 * variance)
    want = np.linalg.solve(d + 2.0 * z @ z.T, score + 0.4 * target)
    got = opt.ridge(score, side, target, x, opt.Optimizer(**(o.__dict__ | {"iterations": 1})), 0.0, variance)
    want = np.where(side > 0, np.maximum(want, 0), np.minimum(want, 0))
    for s in (1, -1):
        want[side == s] *= 0.5 / np.abs(want[side == s]).sum()
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_quadratic_program_keeps_its_limits():
    score, side, target, x = case()
    o = opt.Optimizer(l2=0.5, neutral=True, cost=0.0)
    w, meta = opt.optimize(score, side, target, x, o, 0.2)
    assert meta["backend_used"] == "qp" and abs(w[side > 0].sum() - 0.5) < 1e-5 and abs(w[side < 0].sum() + 0.5) < 1e-5
    assert np.abs(w).max() < 0.2 + 1e-5 and np.abs(opt.standardized(x).T @ w).max() < 1e-4
    # no feasible point nearby is better
    rng = np.random.default_rng(0)
    value = lambda v: score @ v - 0.5 * v @ v
    a = np.concatenate([np.stack([side > 0, side < 0]).astype(float), opt.standardized(x).T])
    free = np.eye(len(w)) - np.linalg.pinv(a) @ a
    for _ in range(300):
        v = w + 0.02 * free @ rng.normal(size=len(w))
        if np.abs(v).max() <= 0.2 and (v * side >= 0).all():
            assert value(v) <= value(w) + 1e-4
    # a turnover cap too small for the sums is found out beforehand, and ridge is used
    w, meta = opt.optimize(score, side, target, x, opt.Optimizer(turnover_cap=0.1), 0.2)
    assert meta["backend_used"] == "ridge" and "turnover_cap_too_small" in meta["fallback"] and np.abs(w).sum() / 2 <= 0.1 + 1e-9


def test_quadratic_programs_of_all_kinds_keep_their_limits():
    """Random problems with every limit: solutions keep all of them to 1e-8, what does not converge falls back and says so."""
    rng, solved = np.random.default_rng(0), 0
    for _ in range(40):
        n = int(rng.integers(6, 40))
        score, side, x = rng.normal(size=n), rng.permutation(np.where(np.arange(n) < n // 2, 1, -1)), rng.normal(size=(n, int(rng.integers(0, 4))))
        target, most = np.where(rng.random(n) < 0.5, 0, side * rng.random(n) / n), float(rng.choice([0, 0.3, 2.0 / n + 0.1]))
        o = opt.Optimizer(l2=float(rng.choice([0.01, 0.5, 2])), turnover=float(rng.choice([0, 0.5])), exposure=1.0, risk=float(rng.choice([0, 1.0])), neutral=bool(rng.random() < 0.5), turnover_cap=float(rng.choice([0, 0.8])))
        costs = {"trade": np.full(n, 1e-3), "borrow": np.full(n, 1e-3), "variance": rng.random(n) * 0.1, "most_trade": np.where(rng.random(n) < 0.3, np.nan, rng.random(n) * 0.5 + 0.05)}
        w, meta = opt.optimize(score, side, target, x, o, most, costs)
        if meta["backend_used"] != "qp":
            assert meta["fallback"].startswith(("qp_precheck_failed:", "qp_failed:unconverged"))
            continue
        solved += 1
        worst = [abs(w[side > 0].sum() - 0.5), abs(w[side < 0].sum() + 0.5), np.nanmax(np.abs(w - target) - costs["most_trade"])]
        worst += [np.abs(w).max() - most] * (most > 0) + [np.abs(w - target).sum() / 2 - o.turnover_cap] * (o.turnover_cap > 0)
        worst += [np.abs(opt.standardized(x).T @ w).max(initial=0.0)] * bool(o.neutral)
        assert max(worst) <= 1e-8 and meta["qp_violation"] <= 1e-9 and (w * side >= -1e-12).all()
    assert solved >= 30


def test_precheck_suggestions():
    side = np.array([1, 1, -1, -1])
    c = opt.precheck(side, np.zeros(4), opt.Optimizer(turnover_cap=0.2), 0.1)
    assert not c["passed"] and {"cap_long_too_tight", "cap_short_too_tight", "turnover_cap_too_small"} <= set(c["reasons"])
    assert all(s["suggested_min"] >= 0.25 for s in c["suggestions"] if "suggested_min" in s)
    assert opt.precheck(side, np.zeros(4), opt.Optimizer(), 0.3)["passed"]
    c = opt.precheck(side, np.zeros(4), opt.Optimizer(), 0.3, np.full(4, 0.01))
    assert "trade_bounds_too_tight_for_required_change" in c["reasons"] and c["reachable_long"] == [0.0, 0.02]
    assert opt.precheck(side, np.zeros(4), opt.Optimizer(neutral=True), 0.3, None, 3)["warnings"]


def test_costs_limits_and_summary():
    score, side, target, x = case()
    dear = opt.cost_aware(np.abs(score), side, 2.0, {"trade": np.where(np.arange(12) == 0, 1.0, 0.0), "borrow": np.full(12, 0.5)})
    assert dear[0] == pytest.approx(abs(score[0]) / 3 + 1.0) and dear[11] == abs(score[11])
    w = opt.ridge(score, side, target, x, opt.Optimizer())
    moved, meta = opt.trade_limits(w, side, target, opt.Optimizer(turnover_cap=0.2), 0.0, np.full(12, 0.05))
    assert np.abs(moved).max() <= 0.05 + 1e-12 and np.abs(moved).sum() / 2 <= 0.2 + 1e-12 and meta["trade_bounds_applied"]
    s = opt.constraint_summary(moved, target, x, opt.Optimizer(turnover_cap=np.abs(moved).sum() / 2), 0.05, np.full(12, 0.05))
    assert "turnover_cap" in s["binding_constraints"] and s["participation"]["max_ratio"] <= 1 + 1e-9
    risky = np.ones(12)
    risky[11] = 50.0
    calm, _ = opt.optimize(score, side, target, x[:, :0], opt.Optimizer(backend="ridge", risk=1.0), 0.0, {"variance": risky})
    bold, _ = opt.optimize(score, side, target, x[:, :0], opt.Optimizer(backend="ridge"), 0.0, {"variance": risky})
    assert calm[11] < bold[11]


def test_risk_model_options():
    rng = np.random.default_rng(7)
    r, b = rng.normal(scale=0.01, size=(80, 6)), rng.normal(size=(6, 2))
    m = opt.factor_risk_model(r, b, specific_clip=0.0, specific_shrink=0.0, shrink=0.0, clip_sigma=0.0, ridge_=1e-12)
    z = (b - b.mean(axis=0)) / b.std(axis=0)
    f = r @ z @ np.linalg.inv(z.T @ z)
    np.testing.assert_allclose(m["factor_cov"], np.cov(f, rowvar=False) * 252, rtol=1e-6)
    np.testing.assert_allclose(m["specific"], (r - f @ z.T).var(axis=0, ddof=1) * 252, rtol=1e-6)
    fixed = opt.factor_risk_model(r, b, shrink=1.0)["factor_cov"]
    assert abs(fixed[0, 1]) < 1e-9
    oas = opt.factor_risk_model(r, b, method="oas", estimator="ewm", halflife=10)
    assert 0 <= oas["shrinkage"] <= 1 and oas["n_eff"] < 80 and np.linalg.eigvalsh(oas["covariance"]).min() > 0
    assert opt.factor_risk_model(np.zeros((80, 6)), b, method="oas")["shrinkage"] == 0.0
    assert opt.factor_risk_model(r[:1], b) is None


def plain_path(targets, ret, cfg, adv=None):
    """The state machine on dense matrices: targets {i: weights}, returns dates x names (row i earns to i + 1)."""
    held, sleeves, net, out = np.zeros(ret.shape[1]), [], [], []
    for i in range(len(ret)):
        sleeves = [s for s in sleeves if s[0] > i]
        scale = 1.0
        if cfg.target_vol and len(net) >= cfg.vol_window:
            sd = np.std(net[-cfg.vol_window :], ddof=1)
            scale = np.clip(cfg.target_vol / 252**0.5 / sd, 0, cfg.max_leverage) if sd > 0 else 1.0
        if i in targets:
            sleeves.append((i + cfg.holding_days, targets[i]))
        goal = sum((w / cfg.sleeves for _, w in sleeves), np.zeros(ret.shape[1])) * scale
        move = goal - held
        turn = np.abs(move).sum() / 2
        if cfg.turnover_cap and turn > cfg.turnover_cap:
            move, turn = move * cfg.turnover_cap / turn, cfg.turnover_cap
        held = held + move
        unit = 0.0 if adv is None else (np.abs(move) * np.minimum(np.abs(move) * cfg.notional / adv[i], cfg.max_participation) ** cfg.impact_exponent).sum()
        g = held @ ret[i]
        net.append(g - turn * 3e-4 - np.abs(move).sum() * cfg.half_spread_bps / 1e4 - unit * cfg.impact_bps / 1e4 + held[held < 0].sum() * cfg.borrow_bps / 1e4 / 252)
        out.append((g, turn, unit, net[-1]))
    return np.array(out)


@pytest.fixture(scope="module")
def market(spark):
    p = sources.synthetic_panel(spark, 90, 12).persist()
    values = plans.run_factors(p, [{"alpha_id": "m", "dsl": "ts_mean(returns(close, 1), 5)"}, {"alpha_id": "r", "dsl": "-returns(close, 1)"}, {"alpha_id": "v", "dsl": "zscore(log1p(volume))"}], max_missing=1.0).values.persist()
    return p, values


@pytest.mark.parametrize("change", [{"holding_days": 3, "rebalance_days": 7}, {"holding_days": 9, "rebalance_days": 4, "target_vol": 0.05, "vol_window": 10}, {"turnover_cap": 0.08, "impact_bps": 20.0}, {"holding_days": 2, "rebalance_days": 5, "impact_bps": 20.0, "half_spread_bps": 3.0}])
def test_backtest_against_a_plain_loop(spark, market, change):
    panel, values = market
    cfg = pf.Backtest(min_obs=4, window=8, min_window_obs=4, **change)
    one = values.where("alpha_id = 'm'")
    got = pf.backtest(one, panel, cfg).orderBy("datetime").toPandas()
    close = panel.toPandas().pivot(index="datetime", columns="instrument", values="close").sort_index()
    ret = (close / close.shift(1) - 1).shift(-1).iloc[:-1].to_numpy()
    t = pf.target_weights(one, panel, cfg).toPandas().pivot(index="datetime", columns="instrument", values="weight").reindex(columns=close.columns).fillna(0.0)
    targets = {list(close.index).index(d): w.to_numpy() for d, w in t.iterrows()}
    adv = risk.exposures(panel, 8, 4).toPandas().pivot(index="datetime", columns="instrument", values="adv").reindex(close.index).to_numpy()
    adv = np.where(np.isnan(adv), 1.0, adv)
    want = plain_path(targets, ret, cfg, adv if cfg.impact_bps else None)
    assert len(got) == len(want)
    np.testing.assert_allclose(got[["gross_return", "turnover", "impact_unit", "net_return"]].to_numpy(), want, atol=1e-10)


def test_optimizer_in_the_backtest(spark, market):
    panel, values = market
    cfg = pf.Backtest(min_obs=4, window=8, min_window_obs=4, holding_days=5, rebalance_days=5, neutralize=("beta",), max_weight=0.3, optimizer=pf.Optimizer(backend="ridge", turnover=1.0, exposure=1.0), notional=1e3)
    got = pf.backtest(values, panel, cfg).toPandas()
    assert set(got.alpha_id) == {"m", "r", "v"} and got.gross_long.max() <= 0.5 + 1e-9 and got.gross_long.max() > 0.2
    again = pf.backtest(values.repartition(7), panel, cfg).toPandas()
    pd.testing.assert_frame_equal(got.sort_values(["alpha_id", "datetime"]).reset_index(drop=True), again.sort_values(["alpha_id", "datetime"]).reset_index(drop=True), atol=1e-9)


def test_repricing_with_a_cap_and_without_shorts(spark, market):
    panel, values = market
    cfg = pf.Backtest(min_obs=4, holding_days=5, rebalance_days=5, borrow_bps=0.0)
    held = pf.held_weights(pf.target_weights(values, panel, cfg), panel, cfg)
    dated = held.join(pf.calendar(panel).select("datetime", "next"), "datetime").select("alpha_id", F.col("next").alias("datetime"), "instrument", "weight")
    assert pf.reprice(dated, panel, pf.with_config(cfg, turnover_cap=0.05)).agg(F.max("turnover")).first()[0] <= 0.05 + 1e-12
    none = panel.select("instrument").distinct()
    assert pf.reprice(dated, panel, cfg, hard_to_borrow=none).agg(F.max("gross_short")).first()[0] == 0
    loose = pf.reprice(dated, panel, pf.with_config(cfg, turnover_cap=9.0)).toPandas().set_index(["alpha_id", "datetime"]).sort_index()
    free = pf.reprice(dated, panel, cfg).toPandas().set_index(["alpha_id", "datetime"]).sort_index()
    np.testing.assert_allclose(loose.net_return, free.net_return.reindex(loose.index), atol=1e-12)


WF = sel.WalkForward(40, 12, 12, 12)
CFG = pf.Backtest(min_obs=4, rebalance_days=3, holding_days=3)


def test_expanding_training_is_read_off_one_path(market):
    """Paths and signs of all training segments, traded one by one, are those that the longest one gives; splits add no rows of the panel."""
    panel, values = market
    table = sel.segments(panel, WF)
    got = sel.walk_forward(values, panel, CFG, WF).where("segment = 'train'").toPandas()
    signed = values.withColumn("sign", F.explode(F.array(F.lit(1), F.lit(-1)))).withColumn("value", F.col("value") * F.col("sign"))
    each = pf.backtest(sel.in_segments(signed, table, "train"), sel.in_segments(panel, table, "train"), CFG, sel.WF_KEYS).persist()
    best = sel.chosen_signs(each)
    want = each.join(best, ["alpha_id", "split_id", "sign"]).toPandas()
    assert got.split_id.nunique() > 1
    order = ["alpha_id", "split_id", "datetime"]
    a, b = (x.sort_values(order).reset_index(drop=True)[[*order, "sign", "net_return", "turnover", "gross_return"]] for x in (got, want))
    pd.testing.assert_frame_equal(a, b, atol=1e-12, check_dtype=False)


@pytest.fixture(scope="module")
def walked(market):
    panel, values = market
    return sel.walk_forward(values, panel, CFG, WF).persist()


def test_walk_forward_equals_backtests_of_segments(spark, market, walked):
    panel, values = market
    table = sel.segments(panel, WF).toPandas()
    part = table[(table.split_id == 1) & (table.segment == "test")].iloc[0]
    inside = F.col("datetime").between(F.lit(part.start), F.lit(part.end))
    sign = {r.alpha_id: r.sign for r in walked.where("split_id = 1").select("alpha_id", "sign").distinct().collect()}
    signed = values.where(inside).withColumn("value", F.col("value") * F.when(F.col("alpha_id") == "m", sign["m"]).when(F.col("alpha_id") == "r", sign["r"]).otherwise(sign["v"]))
    want = pf.backtest(signed, panel.where(inside), CFG).toPandas().set_index(["alpha_id", "datetime"]).net_return.sort_index()
    got = walked.where("split_id = 1 and segment = 'test'").toPandas().set_index(["alpha_id", "datetime"]).net_return.sort_index()
    np.testing.assert_allclose(got, want, atol=1e-12)


def test_ensembles(spark, market, walked):
    panel, values = market
    table, signs = sel.segments(panel, WF), sel.chosen_signs(walked)
    held = ens.segment_holdings(values, panel, signs, table, CFG).toPandas()
    ret = risk.known_returns(sel.in_segments(panel, table, "test")).toPandas()
    path = ens.equal(values, panel, signs, table, CFG).toPandas()
    day = path[path.split_id == 0].sort_values("datetime").iloc[5]
    before = sorted(ret[ret.split_id == 0].datetime.unique())
    at = before[before.index(day.datetime) - 1]
    w = held[(held.split_id == 0) & (held.datetime == at)].groupby("instrument").weight.sum() / 3
    r = ret[(ret.split_id == 0) & (ret.datetime == day.datetime)].set_index("instrument").ret
    assert day.gross_return == pytest.approx(float((w * r.reindex(w.index)).sum()), abs=1e-12)
    paths, weights = ens.allocated(values, panel, walked, table, CFG, min_days=10, cap=0.6)
    assert paths.count() > 0 and np.allclose(weights.groupby("split_id").weight.sum(), 1) and weights.weight.max() <= 0.6 + 1e-6
    out = ens.regime_blend(values, panel, walked, table, CFG, window=5, n_buckets=2, min_days=10, smoothing=0.3)
    assert ens.out_of_sample(out).groupBy("datetime").count().agg(F.max("count")).first()[0] == 1
    tuned = tuning.tune_regimes(spark, tuning.split_returns(walked), {5: ens.market_frame(panel, 5)}, tuning.regime_grid(window=(5,), n_buckets=(1, 2), smoothing=(0.0,)), min_days=10, turnover_cost_bps=5.0)
    assert tuned["chosen"]["objective"] == max(r["objective"] for r in tuned["results"]) and tuned["chosen"]["n_splits_used"] > 0
    again = ens.revalidate(values, panel, walked, table, CFG, tuned["results"], top=1, min_days=10)
    assert len(again["results"]) == 1 and np.isfinite(again["chosen"]["holdings_objective"])
    best = tuning.tune_allocation(spark, tuning.split_returns(walked), min_days=10, most=4)
    assert best["best"]["valid_metric"] == max(r["valid_metric"] for r in best["results"]) and len(best["results"]) == 5


def test_last_position_wins(spark):
    t = datetime(2020, 1, 1)
    rows = spark.createDataFrame([("a", t, "x", 0.1, 1), ("a", t, "x", 0.2, 2), ("a", t, "y", 0.3, 1)], "alpha_id string, datetime timestamp, instrument string, weight double, n int")
    assert {r.instrument: r.weight for r in ens.weight_matrix(rows, ["alpha_id"], "n").collect()} == {"x": 0.2, "y": 0.3}


def test_regimes_choose_two_buckets(spark):
    days = [datetime(2020, 1, 1) + timedelta(days=i) for i in range(60)]
    feats = pd.DataFrame({"mkt_vol": [0.1 if (i // 10) % 2 else 1.0 for i in range(60)], "mkt_liq": 1.0}, index=pd.DatetimeIndex(days))
    rng = np.random.default_rng(0)
    calm = feats.mkt_vol.to_numpy() < 0.5
    r = pd.DataFrame({"A": np.where(calm, 0.01, -0.01) + rng.normal(scale=1e-3, size=60), "B": np.where(calm, -0.01, 0.01) + rng.normal(scale=1e-3, size=60)}, index=feats.index)
    out = tuning.tune_regimes(spark, {0: {"train": r[:40], "valid": r[40:]}}, {20: feats}, tuning.regime_grid(n_buckets=(1, 2), smoothing=(0.0,)), {"cap": 1.0}, min_days=5)
    assert out["chosen"]["n_buckets"] == 2
    assert tuning.labels_of(feats, feats.index[:1], feats.index, "vol_liq", 2) == ["vol_1_liq_0"]


def test_best_rows():
    rows = lambda: [{"id": i, "objective": o, "t": t} for i, (o, t) in enumerate([(1.0, 0.9), (0.8, 0.2), (0.5, 0.1), (0.4, 0.5)])]
    objectives = [("objective", "max"), ("t", "min")]
    assert tuning.best_row(rows(), "objective")[0]["id"] == 0
    chosen, how = tuning.best_row(rows(), "objective", {"max_t": 0.3})
    assert chosen["id"] == 1 and how["selected_by"] == "constrained_best" and how["feasible"] == 2
    chosen, how = tuning.best_row(rows(), "objective", {"max_t": 0.01})
    assert chosen["id"] == 0 and how["selected_by"] == "fallback_unconstrained_no_feasible"
    some = rows()
    tuning.mark_pareto(some, objectives)
    want = [not any(b["objective"] >= a["objective"] and b["t"] <= a["t"] and b is not a for b in some) for a in some]
    assert [r["is_pareto"] for r in some] == want == [True, True, True, False]
    chosen, how = tuning.best_row(some, "objective", prefer_pareto=True, method="knee", objectives=objectives)
    assert chosen["id"] == 1 and how["selected_by"] == "best_objective_pareto_knee"
    assert tuning.best_row(some, "objective", method="utility", objectives=objectives, weights={"objective": 0.0, "t": 1.0})[0]["id"] == 2
    assert tuning.best_row([], "objective")[0] is None
    assert tuning.violations({"n_splits_used": 2}, {"min_splits_used": 3, "max_x": 1.0}) == ["n_splits_used<3", "x>1.0"]


def test_allocation_and_selection(spark):
    rng = np.random.default_rng(7)
    days = [datetime(2020, 1, 1) + timedelta(days=i) for i in range(200)]
    a = rng.normal(0.002, 0.01, 200)
    r = np.stack([a, a + rng.normal(0, 0.001, 200), rng.normal(0, 0.01, 200)], axis=1)
    r[:, 2] += 0.8 * a.mean() - r[:, 2].mean()
    w = sel.fit_allocation(r, penalty=2.0, cap=0.7)
    assert abs(w.sum() - 1) < 1e-9 and w.max() <= 0.7 + 1e-6 and w.min() >= 0
    near = sel.fit_allocation(r, turnover=1e3, before=np.array([0.0, 0.0, 1.0]), rate=1e-4)
    assert near[2] > 0.9
    daily = spark.createDataFrame([(d, n, float(v)) for d, row in zip(days, r) for n, v in zip("ABC", row)], "datetime timestamp, alpha_id string, net_return double")
    got = sel.tune_selection(daily, pools=(3,), penalties=(0.8,), ks=(2,))
    assert set(got["alphas"]) in ({"A", "C"}, {"B", "C"}) and got["enabled"]
    assert not sel.tune_selection(daily, min_valid_ir=1e9)["enabled"]
    some = daily.where("alpha_id <> 'C' or dayofyear(datetime) < 50")
    assert {x.alpha_id for x in sel.valid_candidates(some, min_valid_coverage=0.9).collect()} == {"A", "B"}
    m = spark.createDataFrame([("a", 1e-3, 0.2), ("b", None, None), ("c", 1e-5, 0.9)], "alpha_id string, total_cost_mean double, positive_frac double")
    assert {x.alpha_id for x in sel.selectable(m, 8.0, 0.5).collect()} == {"b", "c"}
    assert sel.schedule_pairs((1, 5), (5,), pf.Backtest(rebalance_days=2, holding_days=2), 2) == [{"rebalance_days": 2, "holding_days": 2}, {"rebalance_days": 1, "holding_days": 5}]


def test_reports_and_run_folder(spark, tmp_path):
    metrics = spark.createDataFrame([("a", 1.0, True), ("b", 0.9, True), ("c", 0.1, False)], "alpha_id string, information_ratio double, passed boolean")
    pairs = spark.createDataFrame([(x, y, 0.5) for x, y in itertools.permutations("abc", 2)], "a string, b string, corr double")
    rows = reporting.selection_report(metrics, pairs, ["a"], penalty=1.0).collect()
    assert [r.alpha_id for r in rows] == ["a", "b", "c"] and rows[0].avg_abs_corr is None and rows[1].adjusted == pytest.approx(0.4)
    results = [{"objective": 1.0, "t": 0.2, "is_pareto": True, "is_feasible": True}, {"objective": 0.5, "t": 0.4, "is_pareto": False, "is_feasible": False}]
    report = reporting.stage_report("proxy", results, results[0], {"selected_by": "x"}, "objective", {"max_t": 0.3})
    assert report["n_feasible"] == 1 and report["chosen"]["slack"]["max_t"] == pytest.approx(0.1) and "| t | 0.2 | 0.1 |" in reporting.stage_markdown([report])
    folder = artifacts.save_run(str(tmp_path), {"x": 1}, {"alpha_metrics": artifacts.metrics_table(metrics)}, thread="a/b c", selected=[{"alpha_id": "a"}], reports={"regime_tuning": report | {"results": results}})
    assert {"sota_alphas.json", "regime_tuning.json", "regime_tuning.csv", "regime_tuning_pareto.csv"} <= set(os.listdir(folder)) and "_a-b-c_" in folder
    assert len(pd.read_csv(f"{folder}/regime_tuning_pareto.csv")) == 1
    other = os.path.basename(artifacts.save_run(str(tmp_path), {"x": 2}, {"alpha_metrics": metrics.withColumn("information_ratio", F.lit(2.0))}))
    assert artifacts.compare_metrics(str(tmp_path), os.path.basename(folder), other).information_ratio_delta.tolist() == pytest.approx([1.0, 1.1, 1.9])


def test_command_line(spark, tmp_path, capsys):
    assert cli.numbers("1, x,2,1,inf") == [1.0, 2.0] and cli.numbers("0,3.7,3", True) == [3] and cli.names("a, B,b,,A") == ["a", "B"] and cli.key_values("a=1,b,=2,c=x, d = 2.5") == {"a": 1.0, "d": 2.5}
    out = str(tmp_path / "runs")
    cli.main(["run", "zscore(returns(close, 1))", "-ts_mean(returns(close, 1), 5)", "--days", "90", "--instruments", "10", "--min-obs", "4", "--train", "40", "--valid", "12", "--test", "12", "--ensemble", "equal", "--out", out])
    cli.main(["list", "--out", out])
    run = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert {"oos", "ensemble", "selection"} <= set(run["tables"]) and len(pd.read_csv(f"{out}/{run['run_id']}/alpha_metrics.csv")) == 2


def test_presets_lint_safety_and_loop():
    assert presets.regime_preset("Stable")["name"] == "low_turnover" and presets.regime_preset("x") is None and presets.regime_preset("execution")["pareto_metrics"]
    assert len(plans.language.critique("zscore(returns(close, 1) * volume)")) == 1 and not plans.language.critique("zscore(returns(close, 1) * log1p(volume))")
    assert plans.language.autofix("returns(close, 1) * ts_mean(volume, 5)")[0] == "returns(close, 1) * ts_zscore(log1p(volume), 5)"
    assert plans.language.autofix("ts_zscore(close, 3) * returns(close, 1) * ts_mean(volume, 5)")[1] == []
    assert safety.scan_code("import numpy as np\ndef f(d):\n    return np.log(d['close']).to_numpy()") == []
    for bad in ("import os", "x = open('f')", "df.to_csv('x')", "pd.io.common", "pd.read_feather('x')", "while True: pass", "a.__class__", "eval('1')", "np.fromfile('x')", "subprocess", "from numpy import load", "globals()", ""):
        assert safety.scan_code(bad), bad
    seen = []
    end = loop.research(lambda s: [{"alpha_id": f"a{s.iteration}"}], lambda a: seen.append(a) or [a[0] | {"metrics": {"information_ratio": len(seen)}}], 30, 25.0)
    assert end.iteration == 25 and len(end.history) == 20 and end.feedback["best_alpha_id"] == "a24"


def test_panel_files_keep_the_last_row(spark, tmp_path):
    with open(tmp_path / "p.csv", "w") as f:
        f.write("datetime,instrument,open,high,low,close,volume\n2020-01-01,a,1,1,1,1,5\n2020-01-01,a,1,1,1,2,5\n2020-01-02,a,,,,3,-4\nbad,a,1,1,1,1,1\n")
    rows = sources.read_panel(spark, str(tmp_path / "p.csv")).orderBy("datetime").collect()
    assert [(r.close, r.open, r.volume) for r in rows] == [(2.0, 1.0, 5.0), (3.0, 2.0, 4.0)]
    with pytest.raises(ValueError):
        sources.read_panel(spark, "x.txt")
    same = spark.createDataFrame([("2020-01-01", "a", 1.0, 1.0, 1.0, c, 1.0) for c in (1.0, 3.0, 2.0)], "datetime string, instrument string, open double, high double, low double, close double, volume double")
    assert {sources.validate_panel(same.repartition(n)).first().close for n in (1, 3)} == {3.0}
