"""Holdings ensembles over walk-forward splits: the alphas' books blended, then priced again as one book.

Three blends: equal weights, weights learned on each split's fitting dates, and weights by market
regime.  Holdings stay in Spark; the weights of alphas (splits x dates x alphas) are a small table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import portfolio as pf
from . import risk
from . import selection as sel
from . import tuning


def segment_holdings(factors: DataFrame, panel: DataFrame, signs: DataFrame, table: DataFrame, cfg: pf.Backtest, segment: str = "test", **market) -> DataFrame:
    """(alpha_id, split_id, segment, datetime, instrument, weight): each alpha's book at the closes of one segment of each split, with the split's sign."""
    part = sel.in_segments(panel, table, segment)
    signed = sel.in_segments(factors, table, segment).join(signs, ["alpha_id", "split_id"]).withColumn("value", F.col("value") * F.col("sign")).drop("sign")
    keys = ["alpha_id", "split_id", "segment"]
    return pf.held_weights(pf.target_weights(signed, part, cfg, keys, **market), part, cfg, keys)


def weight_matrix(positions: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Positions (keys, datetime, instrument, weight) with one row for each place: the last one by ``order``."""
    return positions.groupBy(*keys, "datetime", "instrument").agg(F.max_by("weight", order).alias("weight"))


def priced(blend: DataFrame, panel: DataFrame, table: DataFrame, cfg: pf.Backtest, segment: str = "test", rates: DataFrame | None = None) -> DataFrame:
    """The daily paths (split_id, segment, ...) of blended holdings."""
    keys = ["split_id", "segment"]
    part = sel.in_segments(panel, table, segment)
    if cfg.turnover_cap:
        return pf.sequential(blend, part, pf.with_config(cfg, target_vol=0.0), keys, rates)
    return pf.daily_path(blend, part, cfg, keys, rates)


def out_of_sample(paths: DataFrame, key: str = "ensemble") -> DataFrame:
    """The splits' paths end to end, of repeated dates the first split's, as one alpha."""
    return sel.out_of_sample(paths.withColumn("alpha_id", F.lit(key)))


def equal(factors: DataFrame, panel: DataFrame, signs: DataFrame, table: DataFrame, cfg: pf.Backtest, segment: str = "test", **market) -> DataFrame:
    """The paths of the equally weighted blend of all alphas; an alpha that is flat holds cash."""
    n = factors.select("alpha_id").distinct().count()
    held = segment_holdings(factors, panel, signs, table, cfg, segment, **market)
    blend = held.groupBy("split_id", "segment", "datetime", "instrument").agg((F.sum("weight") / max(n, 1)).alias("weight"))
    return priced(blend, panel, table, cfg, segment, market.get("rates"))


def blended(held: DataFrame, weights: DataFrame) -> DataFrame:
    """Holdings times the alphas' weights (split_id, alpha_id, weight, and, if they change, datetime), summed over the alphas."""
    on = [c for c in ("split_id", "datetime", "alpha_id") if c in weights.columns]
    return held.join(weights.withColumnRenamed("weight", "_a"), on).groupBy("split_id", "segment", "datetime", "instrument").agg(F.sum(F.col("weight") * F.col("_a")).alias("weight")).where("abs(weight) > 1e-12")


def _fit_rows(part: dict[str, pd.DataFrame], fit: str) -> pd.DataFrame | None:
    train, valid = part.get("train"), part.get("valid")
    if train is None or fit == "train" or valid is None:
        return train
    joined = pd.concat([train, valid]).sort_index(kind="stable").fillna(0.0)
    return joined[~joined.index.duplicated(keep="first")]


def allocations(splits: dict[int, dict[str, pd.DataFrame]], fit: str = "train_valid", min_days: int = 30, **cfg) -> pd.DataFrame:
    """(split_id, alpha_id, weight): weights learned on each split's fitting dates, anchored at the split before; few dates: equal weights."""
    out, before = [], None
    for split in sorted(splits):
        rows = _fit_rows(splits[split], fit)
        if rows is None:
            continue
        names = list(rows.columns)
        if len(rows) < min_days:
            w = np.full(len(names), 1 / len(names))
        else:
            w = sel.fit_allocation(rows.to_numpy(), before=None if before is None else before.reindex(names).fillna(0.0).to_numpy(), **(tuning.ALLOCATION | cfg))
        before = pd.Series(w, names)
        out += [(split, a, float(v)) for a, v in before.items()]
    return pd.DataFrame(out, columns=["split_id", "alpha_id", "weight"])


def allocated(factors: DataFrame, panel: DataFrame, paths: DataFrame, table: DataFrame, cfg: pf.Backtest, fit: str = "train_valid", min_days: int = 30, tune: bool = False, **allocation) -> tuple[DataFrame, pd.DataFrame]:
    """The paths of the blend with learned weights, and the weights; with ``tune`` their settings are chosen on the validation dates first."""
    spark, splits = panel.sparkSession, tuning.split_returns(paths)
    if tune:
        allocation = tuning.tune_allocation(spark, splits, allocation, min_days=min_days)["params"]
    weights = allocations(splits, fit, min_days, **allocation)
    held = segment_holdings(factors, panel, _signs(paths), table, cfg)
    rows = spark.createDataFrame(list(weights.itertuples(index=False, name=None)), "split_id int, alpha_id string, weight double").where("weight > 0")
    return priced(blended(held, rows), panel, table, cfg), weights


def _signs(paths: DataFrame) -> DataFrame:
    return sel.local(paths.select("alpha_id", "split_id", "sign").distinct())


def regime_weights(splits: dict[int, dict[str, pd.DataFrame]], features: pd.DataFrame, dates: dict[int, list], fit: str = "train_valid", min_days: int = 30, mode: str = "vol", n_buckets: int = 3, smoothing: float = 0.0, **cfg) -> pd.DataFrame:
    """(split_id, next, alpha_id, weight): the alphas' weights for each date of return in ``dates`` (of each split), by its regime."""
    settings, out, before = tuning.ALLOCATION | cfg, [], {}
    for split in sorted(splits):
        rows = _fit_rows(splits[split], fit)
        if rows is None or split not in dates:
            continue
        names = list(rows.columns)
        if len(rows) < min_days:
            fitted = {"global": np.full(len(names), 1 / len(names))}
        else:
            fitted = tuning.fit_regimes(rows, tuning.labels_of(features, rows.index, rows.index, mode, n_buckets), before, min_days, **settings)
            before = before | fitted
        labels = tuning.labels_of(features, dates[split], rows.index, mode, n_buckets)
        w, _ = sel.daily_weights(labels, {k: v for k, v in fitted.items() if k != "global"}, fitted["global"], smoothing, settings["cap"])
        out += [(split, d, a, float(v)) for d, row in zip(dates[split], w) for a, v in zip(names, row)]
    return pd.DataFrame(out, columns=["split_id", "next", "alpha_id", "weight"])


def market_frame(panel: DataFrame, window: int) -> pd.DataFrame:
    """Market features by date, one row per date, in the driver."""
    return risk.market_features(panel, window).toPandas().set_index("datetime").sort_index()


def regime_blend(factors: DataFrame, panel: DataFrame, paths: DataFrame, table: DataFrame, cfg: pf.Backtest, window: int = 20, segment: str = "test", splits: dict | None = None, **settings) -> DataFrame:
    """The paths of the blend with weights by regime: a date's weights follow the regime of the date of return, which is known at the close before."""
    spark = panel.sparkSession
    splits = tuning.split_returns(paths) if splits is None else splits
    days = pf.calendar(sel.in_segments(panel, table, segment)).where("next is not null").select("split_id", "datetime", "next")
    rows = days.toPandas().sort_values("next")
    weights = regime_weights(splits, market_frame(panel, window), {int(s): list(g["next"]) for s, g in rows.groupby("split_id")}, **settings)
    if not len(weights):
        raise ValueError("no split has returns to fit on")
    dated = weights.merge(rows.astype({"split_id": int}), on=["split_id", "next"])[["split_id", "datetime", "alpha_id", "weight"]]
    table_ = spark.createDataFrame(dated, "split_id int, datetime timestamp, alpha_id string, weight double")
    held = segment_holdings(factors, panel, _signs(paths), table, cfg, segment)
    return priced(blended(held, table_.where("weight > 0")), panel, table, cfg, segment)


def revalidate(factors: DataFrame, panel: DataFrame, paths: DataFrame, table: DataFrame, cfg: pf.Backtest, rows: list[dict], top: int = 3, constraints: dict | None = None, prefer_pareto: bool = False, method: str = "best", weights: dict[str, float] | None = None, **settings) -> dict:
    """The best ``top`` rows of a regime tuning judged again on the holdings of the validation segments, and the chosen one.

    Weights are fitted on the training dates only; the blend is priced with all costs.
    """
    splits = {s: {"train": p["train"]} for s, p in tuning.split_returns(paths).items() if "train" in p}
    out = []
    for row in sorted(rows, key=lambda r: -r["objective"])[:top]:
        path = regime_blend(factors, panel, paths, table, cfg, row["window"], "valid", splits, fit="train", mode=row["mode"], n_buckets=row["n_buckets"], smoothing=row["smoothing"], **settings)
        each = path.groupBy("split_id").agg(F.collect_list("net_return").alias("x"), F.avg("turnover").alias("t"), F.avg("total_cost").alias("c"), F.avg("borrow_cost").alias("b")).collect()
        net = np.concatenate([np.array(r.x) for r in each]) if each else np.zeros(0)
        irs = [tuning.information_ratio(np.array(r.x)) for r in each]
        out.append(row | {"holdings_objective": tuning.information_ratio(net), "ensemble_turnover_mean": float(np.mean([r.t for r in each] or [0.0])), "ensemble_cost_mean": float(np.mean([r.c for r in each] or [0.0])), "ensemble_borrow_mean": float(np.mean([r.b for r in each] or [0.0])),
                          "holdings_objective_split_std": float(np.std(irs, ddof=1)) if len(irs) > 1 else 0.0, "holdings_objective_split_min": min(irs, default=0.0)})
    objectives = [("holdings_objective", "max"), ("ensemble_turnover_mean", "min"), ("ensemble_cost_mean", "min")]
    tuning.mark_pareto(out, objectives)
    chosen, how = tuning.best_row(out, "holdings_objective", constraints, prefer_pareto, method, objectives, weights)
    return {"chosen": chosen, "selection": how, "results": out}
