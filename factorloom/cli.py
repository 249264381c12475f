"""Command line: evaluate factors over a panel, walk forward, select and blend; list, compare and replay runs."""

from __future__ import annotations

import argparse
import json
import math

from . import artifacts


def numbers(text: str | None, whole: bool = False) -> list:
    """Comma-separated finite numbers (``whole``: positive whole ones), each once, in order; what is none is left out."""
    out = []
    for part in (text or "").split(","):
        try:
            v = float(part)
        except ValueError:
            continue
        if math.isfinite(v) and (not whole or v >= 1):
            v = int(v) if whole else v
            if v not in out:
                out.append(v)
    return out


def names(text: str | None) -> list[str]:
    """Comma-separated names, each once in any case, in order."""
    out: dict[str, str] = {}
    for part in (text or "").split(","):
        if part.strip():
            out.setdefault(part.strip().lower(), part.strip())
    return list(out.values())


def key_values(text: str | None) -> dict[str, float]:
    """``key=number`` pairs, comma-separated; what is no finite number is left out."""
    out = {}
    for part in (text or "").split(","):
        key, _, value = part.partition("=")
        got = numbers(value)
        if key.strip() and len(got) == 1:
            out[key.strip()] = got[0]
    return out


def evaluate(spark, config: dict) -> str:
    from . import plans, sources
    from .operators import ensembles, evaluation, portfolio, presets, reporting, selection, tuning

    panel = sources.get_panel(spark, config.get("panel"), **({} if config.get("panel") else {"n_days": config["days"], "n_instruments": config["instruments"], "seed": config["seed"]})).persist()
    alphas = [{"alpha_id": f"alpha_{i}", "dsl": t} for i, t in enumerate(config["factors"])]
    run = plans.run_factors(panel, alphas)
    if run.values is None:
        raise SystemExit(f"no factor is valid: {run.errors}")
    values = run.values.persist()
    cfg = portfolio.Backtest(min_obs=config["min_obs"], rebalance_days=config["rebalance"], holding_days=config["holding"], commission_bps=config.get("commission", 1.0), slippage_bps=config.get("slippage", 2.0), half_spread_bps=config.get("half_spread", 0.0), impact_bps=config.get("impact", 0.0),
                             borrow_bps=config.get("borrow", 50.0), target_vol=config.get("target_vol", 0.0), turnover_cap=config.get("turnover_cap", 0.0), max_weight=config.get("max_weight", 0.0), neutralize=tuple(names(config.get("neutralize"))), optimizer=portfolio.Optimizer(backend=config["optimizer"]) if config.get("optimizer") else None)
    market = {}
    if config.get("sectors"):
        market["sectors"] = sources.sector_map(config["sectors"], spark)
    if config.get("hard_to_borrow"):
        market["hard_to_borrow"] = sources.hard_to_borrow(config["hard_to_borrow"], spark)
    if config.get("borrow_rates"):
        market["rates"] = sources.fill_borrow_rates(sources.borrow_rates(config["borrow_rates"], spark))
    daily = portfolio.backtest(values, panel, cfg, **market).persist()
    pairs = selection.return_correlations(daily)
    summary = portfolio.portfolio_summary(daily)
    tables = {"ic": evaluation.daily_ic(values, evaluation.forward_returns(panel), min_obs=config["min_obs"]), "correlations": pairs.select("a", "b", "corr"), "correlation_nobs": pairs.select("a", "b", "n"), "decay": evaluation.decay(values, panel, min_obs=config["min_obs"])}
    stability, reports = None, {}
    if config.get("train"):
        wf = selection.WalkForward(config["train"], config["valid"], config["test"], config["step"] or config["test"])
        paths = selection.walk_forward(values, panel, cfg, wf, **market).persist()
        tables["oos"], stability = selection.out_of_sample(paths), selection.stability(paths)
        tables["attribution"] = reporting.attribution(paths)
        if config.get("ablation"):
            tables["ablation"] = selection.end_to_end_ablation(values, panel, cfg, wf, **market)
        table = selection.segments(panel, wf)
        if config.get("ensemble") == "equal":
            tables["ensemble"] = ensembles.out_of_sample(ensembles.equal(values, panel, selection.chosen_signs(paths), table, cfg))
        elif config.get("ensemble") == "allocated":
            tables["ensemble"] = ensembles.out_of_sample(ensembles.allocated(values, panel, paths, table, cfg, tune=True)[0])
        elif config.get("ensemble") == "regime":
            preset = presets.regime_preset(config.get("preset")) or presets.regime_preset("aggressive")
            windows = numbers(config.get("regime_windows"), True) or [20]
            splits, features = tuning.split_returns(paths), {w: ensembles.market_frame(panel, w) for w in windows}
            tuned = tuning.tune_regimes(spark, splits, features, tuning.regime_grid(window=windows), turnover_cost_bps=preset["turnover_cost_bps"], constraints=preset["constraints"], prefer_pareto=preset["prefer_pareto"], method=preset["method"], weights=preset["weights"] or None)
            reports["regime_tuning"] = reporting.stage_report("proxy", tuned["results"], tuned["chosen"], tuned["selection"], "objective", preset["constraints"]) | {"results": tuned["results"]}
            tables["ensemble"] = ensembles.out_of_sample(ensembles.regime_blend(values, panel, paths, table, cfg, **(tuned["params"] or {"window": windows[0]})))
    gates = selection.quality_gates(summary, least=key_values(config.get("least")), most=key_values(config.get("most")))
    chosen = selection.select_diverse(daily, config.get("top_k", 3), config.get("penalty", 0.5))
    tables["selection"] = reporting.selection_report(gates, pairs, chosen, penalty=config.get("penalty", 0.5)).withColumn("reasons", _joined("reasons"))
    tables = {"alpha_metrics": artifacts.metrics_table(summary, None, stability, gates)} | tables
    return artifacts.save_run(config["out"], config, tables, {"errors": run.errors, "selected": chosen}, daily, {a["alpha_id"]: a["dsl"] for a in alphas}, config.get("thread", "main"), [a for a in alphas if a["alpha_id"] in chosen], reports)


def _joined(c: str):
    from pyspark.sql import functions as F

    return F.concat_ws(";", c)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="factorloom")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="evaluate factors")
    run.add_argument("factors", nargs="+")
    for name, text in (("panel", None), ("out", "runs"), ("thread", "main"), ("sectors", None), ("hard-to-borrow", None), ("borrow-rates", None), ("neutralize", None), ("least", None), ("most", None), ("preset", None), ("regime-windows", None)):
        run.add_argument(f"--{name}", default=text)
    for name, value in (("days", 252), ("instruments", 50), ("seed", 7), ("min-obs", 20), ("rebalance", 5), ("holding", 5), ("train", 0), ("valid", 42), ("test", 42), ("step", 0), ("top-k", 3)):
        run.add_argument(f"--{name}", type=int, default=value)
    for name, value in (("commission", 1.0), ("slippage", 2.0), ("half-spread", 0.0), ("impact", 0.0), ("borrow", 50.0), ("target-vol", 0.0), ("turnover-cap", 0.0), ("max-weight", 0.0), ("penalty", 0.5)):
        run.add_argument(f"--{name}", type=float, default=value)
    run.add_argument("--optimizer", choices=["auto", "qp", "ridge"])
    run.add_argument("--ensemble", choices=["equal", "allocated", "regime"])
    run.add_argument("--ablation", action="store_true")
    for name in ("list", "compare", "replay"):
        s = sub.add_parser(name)
        s.add_argument("--out", default="runs")
        s.add_argument("names", nargs="*")
    a = vars(p.parse_args(argv))
    command = a.pop("command")
    if command == "list":
        print("\n".join(json.dumps(x) for x in artifacts.list_runs(a["out"])))
        return
    if command == "compare":
        print(json.dumps(artifacts.compare_runs(a["out"], *a["names"]), indent=1))
        print(artifacts.compare_metrics(a["out"], *a["names"]).to_string(index=False))
        return
    from pyspark.sql import SparkSession

    config = artifacts.load_config(a["out"], a["names"][0]) if command == "replay" else a
    print(evaluate(SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.maxPlanStringLength", "1000000").getOrCreate(), config))


if __name__ == "__main__":
    main()
