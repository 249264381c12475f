"""Attribution and comparison tables, constraint slack, and Markdown reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import div

COSTS = ("linear_cost", "spread_cost", "impact_cost", "borrow_cost", "total_cost")


def attribution(paths: DataFrame, keys: tuple[str, ...] = ("alpha_id",)) -> DataFrame:
    """Turnover and cost means of the splits' test segments, weighted by their observations."""
    each = paths.where("segment = 'test'").groupBy(*keys, "split_id").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("turnover", *COSTS)])
    return each.groupBy(*keys).agg(F.sum("n").alias("n_obs"), *[div(F.sum(F.col(c) * F.col("n")), F.sum("n").cast("double")).alias(f"{c}_mean") for c in ("turnover", *COSTS)])


def holdings_against_average(ensemble: DataFrame, daily: DataFrame) -> DataFrame:
    """What blending holdings saves against the alphas' average: cost means and the mean daily difference, in basis points."""
    average = daily.groupBy("datetime").agg(F.avg("total_cost").alias("average_cost"), F.avg("net_return").alias("average_net"))
    both = ensemble.select("datetime", "total_cost", "net_return").join(average, "datetime")
    return both.agg(F.count("*").alias("n_obs"), (F.avg(F.col("average_cost") - F.col("total_cost")) * 1e4).alias("cost_saving_bps"), (F.avg(F.col("net_return") - F.col("average_net")) * 1e4).alias("net_delta_bps"))


def slack(rows: DataFrame, constraints: dict[str, float], key: str = "config_id") -> DataFrame:
    """(key, constraint, actual, bound, slack): room that is left under ``max_`` and above ``min_`` bounds."""
    parts = [F.struct(F.lit(c).alias("constraint"), F.col(c[4:]).cast("double").alias("actual"), F.lit(float(v)).alias("bound"), (F.lit(float(v)) - F.col(c[4:]) if c.startswith("max_") else F.col(c[4:]) - F.lit(float(v))).cast("double").alias("slack")) for c, v in constraints.items()]
    return rows.select(key, F.explode(F.array(*parts)).alias("p")).select(key, "p.*")


def selection_report(metrics: DataFrame, pairs: DataFrame, selected: list[str], score: str = "information_ratio", penalty: float = 0.0, top: int = 15) -> DataFrame:
    """Why alphas were chosen: (alpha_id, score, passed, reasons, selected, avg_abs_corr, max_abs_corr, adjusted), best first.

    ``metrics`` has the score and the quality gates' outcome; ``pairs`` the correlations (a, b, corr).
    The correlations are those with the selected alphas, an alpha itself left out; ``adjusted`` is the
    score less ``penalty`` times the average.
    """
    to = pairs.where(F.col("b").isin(selected) & (F.col("a") != F.col("b"))).groupBy(F.col("a").alias("alpha_id")).agg(F.avg(F.abs("corr")).alias("avg_abs_corr"), F.max(F.abs("corr")).alias("max_abs_corr"))
    gates = [c for c in ("passed", "reasons") if c in metrics.columns]
    rows = metrics.select("alpha_id", F.col(score).alias("score"), *gates).join(to, "alpha_id", "left").withColumns({"selected": F.col("alpha_id").isin(selected), "adjusted": F.col("score") - penalty * F.coalesce("avg_abs_corr", F.lit(0.0))})
    return rows.orderBy(F.col("selected").desc(), F.col("score").desc_nulls_last(), "alpha_id").limit(max(top, len(selected)))


def stage_report(stage: str, rows: list[dict], chosen: dict | None, how: dict, objective: str, constraints: dict | None = None, top: int = 10) -> dict:
    """A tuning stage in short: counts, the chosen row with its room under each limit, and the first rows of the objective."""
    limits = {k: float(v) for k, v in (constraints or {}).items() if v is not None}

    def room(row: dict) -> dict:
        out = {}
        for k, bound in limits.items():
            value = row.get(k[4:])
            if isinstance(value, (int, float)):
                out[k] = bound - value if k.startswith("max_") else value - bound
        return out

    best = sorted(rows, key=lambda r: r.get(objective, float("-inf")), reverse=True)[:top]
    return {"stage": stage, "objective": objective, "n_rows": len(rows), "n_feasible": sum(bool(r.get("is_feasible", True)) for r in rows), "n_pareto": sum(bool(r.get("is_pareto")) for r in rows), "selected_by": how.get("selected_by", ""), "method": how.get("method", ""),
            "chosen": (chosen or {}) | {"slack": room(chosen)} if chosen else {}, "top": [r | {"slack": room(r)} for r in best]}


def stage_markdown(reports: list[dict]) -> str:
    """Stage reports as one Markdown text."""
    out = ["# Selection of regime settings", ""]
    for r in reports:
        out += [f"## {r['stage']}", "", f"{r['n_rows']} rows, {r['n_feasible']} feasible, {r['n_pareto']} on the Pareto front; chosen by {r['selected_by'] or 'nothing'}.", ""]
        if r["chosen"]:
            out += ["| metric | chosen | room |", "|-|-|-|"]
            slack = r["chosen"]["slack"]
            out += [f"| {k} | {v:.6g} | {slack.get('max_' + k, slack.get('min_' + k, '')):.6g} |" if f"max_{k}" in slack or f"min_{k}" in slack else f"| {k} | {v if not isinstance(v, float) else format(v, '.6g')} | |" for k, v in r["chosen"].items() if k != "slack"] + [""]
    return "\n".join(out)


def markdown(title: str, tables: dict[str, DataFrame], rows: int = 20) -> str:
    """A report of the first rows of small tables."""
    out = [f"# {title}", ""]
    for name, df in tables.items():
        some = df.limit(rows).toPandas()
        out += [f"## {name}", "", "| " + " | ".join(some.columns) + " |", "|" + "-|" * len(some.columns)]
        out += ["| " + " | ".join(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in some.itertuples(index=False)] + [""]
    return "\n".join(out)
