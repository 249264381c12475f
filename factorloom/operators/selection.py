"""Walk-forward splits, selection, constraints and Pareto fronts, sweeps, allocation and ensembles.

Tables stay in Spark; only what is bounded by the number of candidates (a correlation matrix, a grid
of configurations, the calendar) is worked on in the driver.
"""

from __future__ import annotations

import dataclasses
import itertools
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from ..functions import div, scrub
from . import portfolio as pf
from .evaluation import YEAR, summarize
from .optimizer import Optimizer, factor_risk_model, feasible, optimize, ridge_weights

# -- walk-forward ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class WalkForward:
    """Lengths of the segments in dates; ``expanding`` keeps the first training date."""

    train: int = 126
    valid: int = 42
    test: int = 42
    step: int = 42
    expanding: bool = True


def splits(dates: list, cfg: WalkForward) -> list[dict]:
    """(split_id, segment, start, end) rows, ends inclusive; a later split must leave a date after its test."""
    need = cfg.train + cfg.valid + cfg.test
    if len(dates) < need + 2:
        raise ValueError(f"walk-forward needs {need + 2} dates, there are {len(dates)}")
    out, begin, number = [], 0, 0
    while begin + need <= len(dates) and (number == 0 or begin + need < len(dates)):
        at = 0 if cfg.expanding else begin
        for name, size in (("train", begin + cfg.train - at), ("valid", cfg.valid), ("test", cfg.test)):
            if size:
                out.append({"split_id": number, "segment": name, "start": dates[at], "end": dates[at + size - 1]})
                at += size
        begin, number = begin + cfg.step, number + 1
    return out


def segments(panel: DataFrame, wf: WalkForward) -> DataFrame:
    """(split_id, segment, start, end): a few rows for each split; the calendar comes to the driver for it."""
    spark = panel.sparkSession
    dates = [r.datetime for r in panel.select("datetime").distinct().orderBy("datetime").collect()]
    return spark.createDataFrame([tuple(x.values()) for x in splits(dates, wf)], "split_id int, segment string, start timestamp, end timestamp")


def in_segments(df: DataFrame, table: DataFrame, *names: str) -> DataFrame:
    """The rows of dated ``df`` once for each segment that holds them: a range join with a short table."""
    some = table.where(F.col("segment").isin(*names)) if names else table
    return df.join(F.broadcast(some), df["datetime"].between(some["start"], some["end"])).drop("start", "end")


WF_KEYS = ["alpha_id", "split_id", "segment", "sign"]


def chosen_signs(paths: DataFrame) -> DataFrame:
    """(alpha_id, split_id, sign): of both signs' training paths that of the larger information ratio (ties: the factor as it is)."""
    ir = paths.where("segment = 'train'").groupBy("alpha_id", "split_id", "sign").agg(F.coalesce(div(F.avg("net_return"), F.stddev_samp("net_return")), F.lit(0.0)).alias("ir"))
    return local(ir.groupBy("alpha_id", "split_id").agg(F.max_by("sign", F.struct("ir", "sign")).alias("sign")))


def local(small: DataFrame) -> DataFrame:
    """A table of as many rows as there are alphas and splits, evaluated now: what is built on it does not repeat its plan."""
    return small.sparkSession.createDataFrame(small.collect(), small.schema)


def signs_at(path: DataFrame, table: DataFrame) -> DataFrame:
    """``chosen_signs`` of training segments that start together, from the one path that they are the beginnings of.

    The path's running mean and deviation are mergeable sums over dates; a segment's are those of its
    last date, which a short table of ends picks.
    """
    w = Window.partitionBy("alpha_id", "sign").orderBy("datetime")
    ever = w.rowsBetween(Window.unboundedPreceding, 0)
    ir = F.coalesce(div(F.avg("net_return").over(ever), F.stddev_samp("net_return").over(ever)), F.lit(0.0))
    running = path.select("alpha_id", "sign", ir.alias("ir"), F.col("datetime").alias("since"), F.lead("datetime").over(w).alias("until"))
    ends = table.where("segment = 'train'").select("split_id", "end")
    at = running.join(F.broadcast(ends), (F.col("since") <= F.col("end")) & (F.col("until").isNull() | (F.col("until") > F.col("end"))))
    return local(at.groupBy("alpha_id", "split_id").agg(F.max_by("sign", F.struct("ir", "sign")).alias("sign")))


def walk_forward(factors: DataFrame, panel: DataFrame, cfg: pf.Backtest, wf: WalkForward, **market) -> DataFrame:
    """Daily paths of all splits: (alpha_id, split_id, segment, sign, ...).

    Every segment starts anew (its exposures know nothing before it).  Both signs are traded on the
    training segment; the better one goes on to validation and test.  A day of a path depends only on
    the days before it, so expanding training segments are beginnings of the longest one: that is
    the only one to be traded, and the panel is read once for all of them.  Segments are keys of the
    panel and of the paths: all validation and test segments are one plan, as are all training
    segments that don't start together.  ``market``: sectors, rates and names that can't be borrowed,
    as for a backtest.
    """
    table = segments(panel, wf)
    signed = factors.withColumn("sign", F.explode(F.array(F.lit(1), F.lit(-1)))).withColumn("value", F.col("value") * F.col("sign"))
    traded = table.where("segment = 'train'")
    if wf.expanding:
        traded = traded.orderBy(F.col("end").desc()).limit(1)
    train = pf.backtest(in_segments(signed, traded), in_segments(panel, traded), cfg, WF_KEYS, check=False, **market)
    if wf.expanding:
        # read for the signs and for the paths; it has a row for each date, alpha and sign
        path = train.drop("split_id", "segment").persist()
        best, train = signs_at(path, table), in_segments(path, table, "train")
    else:
        best = chosen_signs(train)
    later = in_segments(signed, table, "valid", "test").join(best, ["alpha_id", "split_id", "sign"], "left_semi")
    rest = pf.backtest(later, in_segments(panel, table, "valid", "test"), cfg, WF_KEYS, check=False, **market)
    return train.join(best, ["alpha_id", "split_id", "sign"], "left_semi").unionByName(rest)


def out_of_sample(paths: DataFrame) -> DataFrame:
    """The test segments end to end; of repeated dates the first split's."""
    w = Window.partitionBy("alpha_id", "datetime").orderBy("split_id")
    return paths.where("segment = 'test'").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def stability(paths: DataFrame) -> DataFrame:
    """Over the splits: mean, deviation, least, median and largest test information ratio, share of positive ones, and the gap to training."""
    each = paths.groupBy("alpha_id", "split_id").agg(*[F.coalesce(div(F.avg(x), F.stddev_samp(x)), F.lit(0.0)).alias(s) for s, x in ((s, F.when(F.col("segment") == s, F.col("net_return"))) for s in ("train", "test"))])
    t = F.col("test") * YEAR**0.5
    return each.groupBy("alpha_id").agg(F.count("*").alias("n_splits"), F.avg(t).alias("ir_mean"), F.stddev_samp(t).alias("ir_std"), F.min(t).alias("ir_min"), F.median(t).alias("ir_median"), F.max(t).alias("ir_max"), F.avg((t > 0).cast("double")).alias("positive_frac"), F.avg(F.col("train") * YEAR**0.5 - t).alias("train_test_gap"))


# -- selection --------------------------------------------------------------------------------------


#: Alphas of a block of ``return_correlations``.
BLOCK = 64
_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _tile_sums(batches, size: int):
    """Of rows (p, q, left, right), arrays of (place, value) of two blocks on one date: the sums over the dates of each pair of places, tile by tile."""

    def table(arrays) -> np.ndarray:
        """Dates x places, NaN where an alpha has no value."""
        out, flat = np.full((len(arrays), size), np.nan), arrays.flatten()
        row = np.repeat(np.arange(len(arrays)), pc.list_value_length(arrays).to_numpy(zero_copy_only=False))
        out[row, flat.field("place").to_numpy()] = flat.field("x").to_numpy(zero_copy_only=False)
        return out

    def packed(tile, sums) -> pa.RecordBatch:
        i, j = np.nonzero(sums[0])
        same = tile[0] == tile[1]
        keep = (i <= j) if same else np.ones(len(i), bool)  # the upper half
        i, j = i[keep], j[keep]
        columns = [pa.array(tile[0] * size + i, pa.int64()), pa.array(tile[1] * size + j, pa.int64()), *[pa.array(m[i, j]) for m in sums]]
        return pa.RecordBatch.from_arrays(columns, ["i", "j", *_SUMS])

    now, sums = None, None
    for batch in batches:
        p, q = batch["p"].to_numpy(), batch["q"].to_numpy()
        cuts = [0, *(np.flatnonzero((p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1).tolist(), len(p)]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi == lo:
                continue
            tile = (int(p[lo]), int(q[lo]))
            if tile != now:
                if now is not None:
                    yield packed(now, sums)
                now, sums = tile, np.zeros((6, size, size))
            x, y = table(batch["left"].slice(lo, hi - lo)), table(batch["right"].slice(lo, hi - lo))
            mx, my = (~np.isnan(x)).astype(float), (~np.isnan(y)).astype(float)
            x, y = np.nan_to_num(x), np.nan_to_num(y)
            sums += np.stack([mx.T @ my, x.T @ my, mx.T @ y, (x * x).T @ my, mx.T @ (y * y), x.T @ y])
    if now is not None:
        yield packed(now, sums)


def return_correlations(daily: DataFrame, x: str = "net_return", min_periods: int = 20) -> DataFrame:
    """(a, b, corr, n) of all pairs of alphas over their common dates.

    A tiled product: alphas are numbered and cut into blocks of ``BLOCK``, a date has one row for each
    pair of blocks of the upper half (two arrays), and a tile's task adds up products of matrices; a
    year's tiles are apart from another's.  Values are taken less their alpha's mean first.  Numbers
    of alphas come to the driver (a name and a mean each), dates and values don't.  Dates of an alpha
    should be distinct.  ``daily`` is read twice: keep it if it is a plan of its own.
    """
    spark, size = daily.sparkSession, BLOCK
    known = daily.select("datetime", "alpha_id", scrub(F.col(x).cast("double")).alias("x"))
    names = [(r.alpha_id, k, r.mean) for k, r in enumerate(known.groupBy("alpha_id").agg(F.avg("x").alias("mean")).orderBy("alpha_id").collect())]
    numbered = spark.createDataFrame(names, known.select("alpha_id").schema.add("k", IntegerType()).add("mean", DoubleType()))
    values = known.where("x is not null").join(F.broadcast(numbered), "alpha_id")
    entry = F.struct((F.col("k") % size).alias("place"), (F.col("x") - F.col("mean")).alias("x"))
    blocks = values.groupBy("datetime", F.floor(F.col("k") / size).cast("int").alias("block")).agg(F.collect_list(entry).alias("v"))
    dates = blocks.groupBy("datetime").agg(F.collect_list(F.struct("block", "v")).alias("all"))
    one = dates.select("datetime", "all", F.explode("all").alias("l")).select("datetime", "l", F.explode("all").alias("r")).where("l.block <= r.block")
    tiles = one.select(F.col("l.block").alias("p"), F.col("r.block").alias("q"), F.year("datetime").alias("year"), F.col("l.v").alias("left"), F.col("r.v").alias("right"))
    sums = tiles.repartition("p", "q", "year").sortWithinPartitions("p", "q", "year").drop("year").mapInArrow(lambda batches: _tile_sums(batches, size), "i long, j long, " + ", ".join(f"{c} double" for c in _SUMS))
    total = sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in _SUMS])
    n = F.col("n")
    var = lambda s, ss: F.greatest(F.col(ss) - F.col(s) * F.col(s) / n, F.lit(0.0))
    spread = F.sqrt(var("sx", "sxx") * var("sy", "syy"))
    # rounding of sums leaves a constant series a spread of about 1e-16 of its squares
    flat = (var("sx", "sxx") <= 1e-14 * F.col("sxx")) | (var("sy", "syy") <= 1e-14 * F.col("syy"))
    corr = F.when((n >= min_periods) & ~flat, div(F.col("sxy") - F.col("sx") * F.col("sy") / n, spread))
    # pairs with a common date have a row, in both directions
    names_of = lambda c, i: numbered.select(F.col("k").cast("long").alias(i), F.col("alpha_id").alias(c))
    half = total.select("i", "j", F.col("n").cast("long").alias("n"), corr.alias("corr")).join(F.broadcast(names_of("a", "i")), "i").join(F.broadcast(names_of("b", "j")), "j")
    both = F.when(F.col("i") == F.col("j"), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return half.select(F.explode(both).alias("p"), "corr", "n").select("p.a", "p.b", "n", "corr")


def correlation_summary(pairs: DataFrame) -> DataFrame:
    off = F.when(F.col("a") != F.col("b"), F.abs("corr"))
    return pairs.agg(F.avg(off).alias("avg_abs_corr"), F.max(off).alias("max_abs_corr"))


def equal_weight_ensemble(daily: DataFrame, x: str = "net_return") -> DataFrame:
    return daily.groupBy("datetime").agg(F.avg(x).alias(x), F.count(x).alias("n_alphas"))


def quality_gates(metrics: DataFrame, least: dict[str, float] | None = None, most: dict[str, float] | None = None) -> DataFrame:
    """``passed`` and the list of broken limits; a missing metric breaks its limit."""
    checks = [(f"{c} < {v:g}", F.coalesce(F.col(c) < v, F.lit(True))) for c, v in (least or {}).items()] + [(f"{c} > {v:g}", F.coalesce(F.col(c) > v, F.lit(True))) for c, v in (most or {}).items()]
    reasons = F.array_compact(F.array(*[F.when(bad, F.lit(s)) for s, bad in checks]))
    return metrics.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)


def top_k(metrics: DataFrame, score: str, k: int, tie: str = "alpha_id") -> DataFrame:
    return metrics.where(F.col(score).isNotNull() & (F.col(score) > float("-inf"))).orderBy(F.col(score).desc(), tie).limit(k)


def greedy_diverse(scores: dict[str, float], pairs: dict[tuple[str, str], float], k: int, penalty: float = 0.5, most_corr: float | None = None) -> list[str]:
    """Repeatedly the candidate of the largest score less ``penalty`` times its mean |correlation| with those chosen."""
    chosen: list[str] = []
    rest = sorted(scores, key=lambda a: (-scores[a], a))
    while rest and len(chosen) < k:
        def value(a):
            rho = [abs(pairs.get((a, b), 0.0) or 0.0) for b in chosen]
            return float("-inf") if rho and most_corr is not None and max(rho) > most_corr else scores[a] - penalty * (sum(rho) / len(rho) if rho else 0.0)

        best = max(rest, key=value)
        if value(best) == float("-inf"):
            break
        chosen.append(best)
        rest.remove(best)
    return chosen


def thin(grid: list, most: int) -> list:
    """At most ``most`` of a grid's points, evenly spaced, first and last included."""
    return grid if len(grid) <= most else [grid[i] for i in np.unique(np.linspace(0, len(grid) - 1, most).round().astype(int))]


def select_diverse(daily: DataFrame, k: int = 2, penalty: float = 0.5, x: str = "net_return") -> list[str]:
    """Greedy choice on information ratios and correlations (both as many as there are candidates)."""
    daily = daily.select("alpha_id", "datetime", x).persist()  # computed once for both
    s = {r.alpha_id: r.information_ratio for r in summarize(daily, ["alpha_id"], x).collect()}
    pairs = {(r.a, r.b): r["corr"] for r in return_correlations(daily, x).collect()}
    daily.unpersist()
    return greedy_diverse(s, pairs, k, penalty)


def selectable(metrics: DataFrame, max_total_cost_bps: float | None = None, min_positive_frac: float | None = None) -> DataFrame:
    """The rows whose known mean cost and known share of positive test splits keep the limits; unknown ones stay."""
    out = metrics
    if max_total_cost_bps is not None:
        out = out.where(F.coalesce(F.col("total_cost_mean") * 1e4 <= max_total_cost_bps, F.lit(True)))
    if min_positive_frac is not None:
        out = out.where(F.coalesce(F.col("positive_frac") >= min_positive_frac, F.lit(True)))
    return out


def valid_candidates(valid: DataFrame, min_valid_ir: float | None = None, min_valid_coverage: float | None = None, x: str = "net_return") -> DataFrame:
    """(alpha_id, valid_ir, valid_coverage) of the alphas that keep both limits; coverage is the share of all validation dates with a return."""
    n = valid.agg(F.countDistinct("datetime").alias("dates"))
    rows = summarize(valid, ["alpha_id"], x).crossJoin(F.broadcast(n)).select("alpha_id", F.col("information_ratio").alias("valid_ir"), (F.col("n_obs") / F.col("dates")).alias("valid_coverage"))
    if min_valid_ir is not None:
        rows = rows.where(F.col("valid_ir") >= min_valid_ir)
    return rows.where(F.col("valid_coverage") >= min_valid_coverage) if min_valid_coverage is not None else rows


def tune_selection(valid: DataFrame, pools=(10, 20), penalties=(0.0, 0.2, 0.5, 0.8), ks=(3,), most: int = 24, x: str = "net_return", min_valid_ir: float | None = None, min_valid_coverage: float | None = None, max_pairwise_corr: float | None = None, min_periods: int = 20) -> dict:
    """The (pool, penalty, k) whose greedy choice has the best equally weighted ensemble on the validation returns.

    Scores and correlations come from Spark, as many as there are candidates (and pairs of them);
    the returns of the candidates on the validation dates are a small matrix in the driver.
    """
    rows = valid_candidates(valid, min_valid_ir, min_valid_coverage, x).orderBy(F.col("valid_ir").desc(), "alpha_id").collect()
    scores = {r.alpha_id: r.valid_ir for r in rows}
    if len(scores) < 2:
        return {"enabled": False, "error": "too few candidates", "results": []}
    some = valid.where(F.col("alpha_id").isin(*scores))
    pairs = {(r.a, r.b): r["corr"] for r in return_correlations(some, x, min_periods).collect()}
    wide = some.select("datetime", "alpha_id", F.col(x).alias("x")).toPandas().pivot(index="datetime", columns="alpha_id", values="x")
    results = []
    for pool, penalty, k in thin(list(itertools.product(pools, penalties, ks)), most):
        names = greedy_diverse(dict(list(scores.items())[:pool]), pairs, k, penalty, max_pairwise_corr)
        stream = wide[names].mean(axis=1).dropna()
        sd = stream.std(ddof=1) if len(stream) > 1 else 0.0
        results.append({"pool": pool, "penalty": penalty, "k": k, "alphas": names, "valid_ir": float(stream.mean() / sd * YEAR**0.5) if sd > 0 else 0.0})
    best = max(results, key=lambda r: r["valid_ir"])
    return {"enabled": True, "best": best, "alphas": best["alphas"], "results": sorted(results, key=lambda r: -r["valid_ir"])}


# -- constraints and Pareto fronts ---------------------------------------------------------------------


def constrain(rows: DataFrame, most: dict[str, float] | None = None, least: dict[str, float] | None = None) -> DataFrame:
    """Violations of each limit, summed; a missing metric violates by infinity."""
    terms = [F.coalesce(F.greatest(F.col(c) - v, F.lit(0.0)), F.lit(float("inf"))) for c, v in (most or {}).items()] + [F.coalesce(F.greatest(F.lit(v) - F.col(c), F.lit(0.0)), F.lit(float("inf"))) for c, v in (least or {}).items()]
    return rows.withColumn("violation", sum(terms, F.lit(0.0))).withColumn("feasible", F.col("violation") <= 0)


#: Buckets of the first of two objectives; most cells of a grid over three and more.
BUCKETS, CELLS = 256, 1024


def _borders(rows: DataFrame, c: str, n: int, apart: float) -> list[float]:
    """Up to n - 1 borders between about equal parts of a column, further apart than ``apart``."""
    out: list[float] = []
    for q in sorted(rows.approxQuantile(c, [k / n for k in range(1, n)], 0.25 / n)) if n > 1 else []:
        if not out or q - out[-1] > apart:
            out.append(q)
    return out


def _part(x: Column, borders: list[float]) -> Column:
    """How many borders are not above x."""
    return F.size(F.filter(F.array(*map(F.lit, borders)), lambda b: b <= x)) if borders else F.lit(0)


def _dominated_of_two(scored: DataFrame, eps: float) -> DataFrame:
    """``scored`` with ``_d``: whether a row has one above it on ``_o0`` and ``_o1``.

    Rows above on the first objective count by their largest second one: of the same bucket by a
    running maximum, of higher buckets by one number each.  Rows within eps of a border are in both
    buckets.  Only borders and numbers of buckets come to the driver.
    """
    best = scored.groupBy("_o0").agg(F.max("_o1").alias("m"))
    borders = _borders(best, "_o0", BUCKETS, 4 * eps)
    bounds = F.array(F.lit(float("-inf")), *map(F.lit, borders), F.lit(float("inf")))
    placed = best.withColumn("b", _part(F.col("_o0"), borders))
    low, high = F.element_at(bounds, F.col("b") + 1), F.element_at(bounds, F.col("b") + 2)
    tops = {r.b: (r.top, r.far) for r in placed.groupBy("b").agg(F.max("m").alias("top"), F.max(F.when(F.col("_o0") > low + eps, F.col("m"))).alias("far")).collect()}
    above, most = [], None
    for b in range(len(borders), -1, -1):
        # higher buckets whole, but for the rows of the next one that are within eps of the border
        next_far = tops.get(b + 1, (None, None))[1]
        above.append(max((x for x in (most, next_far) if x is not None), default=None))
        most = max((x for x in (most, tops.get(b + 1, (None, None))[0]) if x is not None), default=None)
    own = F.array(F.struct("b", F.lit(True).alias("own")))
    copies = F.concat(own, F.when(F.col("_o0") + eps >= high, F.array(F.struct((F.col("b") + 1).alias("b"), F.lit(False).alias("own")))).otherwise(F.array().cast("array<struct<b:int,own:boolean>>")), F.when(F.col("_o0") - eps <= low, F.array(F.struct((F.col("b") - 1).alias("b"), F.lit(False).alias("own")))).otherwise(F.array().cast("array<struct<b:int,own:boolean>>")))
    spread = placed.select("_o0", "m", F.inline(copies)).withColumn("x", -F.col("_o0"))
    over = "max(m) OVER (PARTITION BY b ORDER BY x {} BETWEEN UNBOUNDED PRECEDING AND {})"
    least, rounded_off = f"{eps * (1 + 1e-9)!r}D", F.col("x") - eps == F.col("x")  # eps may be less than a value's last digit
    beyond = F.when(rounded_off, F.expr(over.format("ROWS", "1 PRECEDING"))).otherwise(F.expr(over.format("RANGE", f"{least} PRECEDING")))
    ran = spread.withColumns({"beyond": beyond, "upto": F.expr(over.format("RANGE", f"{eps!r}D FOLLOWING"))}).where("own")
    higher = F.element_at(F.array(*[F.lit(x).cast("double") for x in above[::-1]]), F.col("b") + 1)
    known = ran.select("_o0", F.greatest("beyond", higher).alias("_beyond"), F.greatest("upto", higher).alias("_upto"))
    d = F.coalesce(F.col("_beyond") >= F.col("_o1") - eps, F.lit(False)) | (F.col("_upto") > F.col("_o1") + eps)
    return scored.join(known, "_o0").withColumn("_d", d).drop("_beyond", "_upto")


def _dominated_in_grid(scored: DataFrame, n: int, eps: float) -> DataFrame:
    """``scored`` with ``_d``, for three and more objectives, by a grid of at most ``CELLS`` cells between quantiles.

    A cell with another one above it in all objectives (by two borders in one of them, so by more than
    eps) has no row on the front, and is not needed to keep others off it.  Rows of the cells left
    meet those of cells that are not below theirs: rows are joined by cell, and only counts of cells
    come to the driver.  Equal rows count once.
    """
    names = [f"_o{i}" for i in range(n)]
    once = scored.select(*names).distinct()
    g = max(int(CELLS ** (1 / n) + 1e-9), 2)
    borders = [_borders(once, c, g, 4 * eps) for c in names]
    cell = lambda shift: F.array(*[_part(F.col(c) - shift, b) for c, b in zip(names, borders)])
    # a row is judged from eps below its place, and judges from its own
    placed = once.withColumns({"_low": cell(eps), "_cell": cell(0.0)})
    full = np.array([r["_cell"] for r in placed.select("_cell").distinct().collect()]).reshape(-1, n)
    judged = np.array([r["_low"] for r in placed.select("_low").distinct().collect()]).reshape(-1, n)
    beaten = lambda c: ((full >= c + 1).all(axis=1) & (full >= c + 2).any(axis=1)).any() if len(full) else False
    judged = [c for c in judged if not beaten(c)]
    rulers = [c for c in full if not beaten(c)]
    meets = [(c.tolist(), [a.tolist() for a in judged if (c >= a).all()]) for c in rulers]
    spark = scored.sparkSession
    open_cells = spark.createDataFrame([(c.tolist(),) for c in judged], "_low array<int>")
    ruled = spark.createDataFrame(meets, "_cell array<int>, _lows array<array<int>>")
    candidates = placed.join(F.broadcast(open_cells), "_low").select(*names, "_low")
    rivals = placed.join(F.broadcast(ruled), "_cell").select(*[F.col(c).alias(f"{c}_b") for c in names], F.explode("_lows").alias("_low_b"))
    no_worse, better = F.lit(True), F.lit(False)
    for c in names:
        no_worse = no_worse & (F.col(f"{c}_b") >= F.col(c) - eps)
        better = better | (F.col(f"{c}_b") > F.col(c) + eps)
    front = candidates.join(rivals, (F.col("_low") == F.col("_low_b")) & no_worse & better, "left_anti").select(*names, F.lit(False).alias("_d"))
    return scored.join(front, names, "left").withColumn("_d", F.coalesce("_d", F.lit(True)))


def pareto(rows: DataFrame, maximize: list[str], minimize: list[str], key: str = "config_id", eps: float = 1e-12) -> DataFrame:
    """``is_pareto``: no other row is as good on all objectives and better on one (by more than ``eps``); ``pareto_rank`` 1 or 2.

    Rows without all objectives go.  Two objectives take running maxima, more a grid.
    """
    objectives = [*[F.col(c) for c in maximize], *[-F.col(c) for c in minimize]]
    if not objectives:
        raise ValueError("no objectives")
    if len(objectives) == 1:
        objectives.append(F.lit(0.0))
    hidden = [f"_o{i}" for i in range(len(objectives))]
    scored = rows.withColumns({c: scrub(o.cast("double")) + 0.0 for c, o in zip(hidden, objectives)}).dropna(subset=hidden)
    marked = _dominated_of_two(scored, eps) if len(hidden) == 2 else _dominated_in_grid(scored, len(hidden), eps)
    return marked.withColumn("is_pareto", ~F.col("_d")).drop("_d", *hidden).withColumn("pareto_rank", F.when(F.col("is_pareto"), 1).otherwise(2))


def goodness(rows: DataFrame, metrics: dict[str, str], larger: dict[str, bool] | None = None) -> DataFrame:
    """``rows`` with each metric scaled to 0..1 over all of them, 1 best; a constant metric is 1.  ``metrics``: column to new column.

    Least and largest values are one aggregated row, joined back.
    """
    ends = rows.agg(*[f(c).alias(f"_{n}_{c}") for c in metrics for n, f in (("lo", F.min), ("hi", F.max))])
    out = {}
    for c, name in metrics.items():
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        up = div(F.col(c) - lo, hi - lo) if (larger or {}).get(c, True) else 1 - div(F.col(c) - lo, hi - lo)
        out[name] = F.coalesce(up, F.lit(1.0))
    return rows.crossJoin(F.broadcast(ends)).withColumns(out).drop(*ends.columns)


def knee(rows: DataFrame, maximize: list[str], minimize: list[str], key: str = "config_id") -> DataFrame:
    """The row nearest to the ideal point of the scaled objectives; ties go to the first key."""
    names = {c: f"_g{i}" for i, c in enumerate([*maximize, *minimize])}
    scaled = goodness(rows, names, {c: c in maximize for c in names})
    return scaled.withColumn("distance", F.sqrt(sum(((1 - F.col(g)) ** 2 for g in names.values()), F.lit(0.0)))).drop(*names.values()).orderBy("distance", key).limit(1)


def utility(rows: DataFrame, weights: dict[str, float], key: str = "config_id") -> DataFrame:
    """Rows by the weighted sum of scaled metrics (a negative weight: smaller is better), best first."""
    names = {c: f"_g{i}" for i, c in enumerate(weights)}
    scaled = goodness(rows, names, {c: w >= 0 for c, w in weights.items()})
    total = sum((abs(w) * F.col(names[c]) for c, w in weights.items()), F.lit(0.0))
    return scaled.withColumn("utility", total).drop(*names.values()).orderBy(F.col("utility").desc(), key)


# -- sweeps ----------------------------------------------------------------------------------------------


def sweep(factors: DataFrame, panel: DataFrame, base: pf.Backtest, grid: dict[str, list], most: int = 24) -> DataFrame:
    """The summary of each configuration of a grid, the base first; at most ``most`` of them."""
    points = [{}] + [dict(zip(grid, p)) for p in itertools.product(*grid.values())]
    return _configurations(factors, panel, base, [points[0], *thin(points[1:], most - 1)])


def _configurations(factors: DataFrame, panel: DataFrame, base: pf.Backtest, points: list[dict]) -> DataFrame:
    out = None
    for i, change in enumerate(points):
        daily = pf.backtest(factors, panel, pf.with_config(base, **change), check=not i)
        row = pf.portfolio_summary(daily).withColumns({"config_id": F.lit(i), "config": F.lit(", ".join(f"{k}={v}" for k, v in change.items()))})
        out = row if out is None else out.unionByName(row)
    return out


def schedule_sweep(factors: DataFrame, panel: DataFrame, base: pf.Backtest, rebalance=(1, 5, 10), holding=(5, 10), most: int = 25) -> DataFrame:
    return sweep(factors, panel, base, {"rebalance_days": list(rebalance), "holding_days": list(holding)}, most)


def schedule_pairs(rebalance, holding, base: pf.Backtest, most: int = 25) -> list[dict]:
    """The (rebalance, holding) pairs of a sweep in order, the base's among them (first, where there are more than ``most``)."""
    own = (base.rebalance_days, base.holding_days)
    pairs = sorted({(r, h) for r in rebalance for h in holding if r > 0 and h > 0})
    pairs = pairs if own in pairs else [own, *pairs]
    if len(pairs) > most:
        pairs = [own, *[p for p in pairs if p != own][: most - 1]]
    return [{"rebalance_days": r, "holding_days": h} for r, h in pairs]


def best_schedule(factors: DataFrame, panel: DataFrame, base: pf.Backtest, rebalance=(1, 5, 10), holding=(5, 10), most: int = 25) -> DataFrame:
    """(alpha_id, config, information_ratio) of each alpha's best pair of a schedule sweep; ties go to the first."""
    rows = _configurations(factors, panel, base, schedule_pairs(rebalance, holding, base, most))
    return rows.groupBy("alpha_id").agg(F.max_by(F.struct("config", "information_ratio"), F.struct("information_ratio", -F.col("config_id"))).alias("b")).select("alpha_id", "b.config", "b.information_ratio")


#: The scenarios of an end-to-end ablation and the settings that each changes.
END_TO_END = {
    "no_costs": {"commission_bps": 0.0, "slippage_bps": 0.0, "half_spread_bps": 0.0, "impact_bps": 0.0, "borrow_multiplier": 0.0},
    "linear_only": {"half_spread_bps": 0.0, "impact_bps": 0.0, "borrow_multiplier": 0.0},
    "linear_spread": {"impact_bps": 0.0, "borrow_multiplier": 0.0},
    "linear_spread_impact": {"borrow_multiplier": 0.0},
    "full": {},
}


def end_to_end_ablation(factors: DataFrame, panel: DataFrame, cfg: pf.Backtest, wf: WalkForward, **market) -> DataFrame:
    """The out-of-sample summary under each cost scenario, with the choice of signs done again under it.

    Where costs do not change the books, all scenarios are priced from one plan of both signs' paths;
    else (volatility target, turnover cap, optimizer) the walk-forward is done again for each.
    """
    settings = {}
    for name, change in END_TO_END.items():
        own = dict(change)
        if cfg.optimizer is not None and name == "no_costs":
            own["optimizer"] = dataclasses.replace(cfg.optimizer, cost=0.0)
        settings[name] = pf.with_config(cfg, **own)
    if cfg.target_vol or cfg.turnover_cap or cfg.optimizer is not None:
        out = None
        for name, own in settings.items():
            row = local(pf.portfolio_summary(out_of_sample(walk_forward(factors, panel, own, wf, **market)))).withColumn("scenario", F.lit(name))
            out = row if out is None else out.unionByName(row)
        return out
    table = segments(panel, wf)
    signed = factors.withColumn("sign", F.explode(F.array(F.lit(1), F.lit(-1)))).withColumn("value", F.col("value") * F.col("sign"))
    # read for the signs and for the tests; it has a row for each date, alpha and sign
    paths = pf.backtest(in_segments(signed, table, "train", "test"), in_segments(panel, table, "train", "test"), cfg, WF_KEYS, check=False, **market).persist()
    rates = [F.struct(F.lit(n).alias("scenario"), *[F.lit(float(v)).alias(c) for c, v in (("_l", s.commission_bps + s.slippage_bps), ("_s", s.half_spread_bps), ("_i", s.impact_bps), ("_b", s.borrow_multiplier))]) for n, s in settings.items()]
    units = {"linear_cost": F.col("turnover") * F.col("r._l") / 1e4, "spread_cost": F.col("traded") * F.col("r._s") / 1e4, "impact_cost": F.col("impact_unit") * F.col("r._i") / 1e4, "borrow_cost": F.col("borrow_unit") * F.col("r._b")}
    each = paths.withColumn("r", F.explode(F.array(*rates))).withColumns(units).withColumn("total_cost", sum((F.col(c) for c in units), F.lit(0.0)))
    each = each.withColumns({"net_return": F.col("gross_return") - F.col("total_cost"), "scenario": F.col("r.scenario")}).drop("r")
    ir = each.where("segment = 'train'").groupBy("scenario", "alpha_id", "split_id", "sign").agg(F.coalesce(div(F.avg("net_return"), F.stddev_samp("net_return")), F.lit(0.0)).alias("ir"))
    best = local(ir.groupBy("scenario", "alpha_id", "split_id").agg(F.max_by("sign", F.struct("ir", "sign")).alias("sign")))
    tested = each.where("segment = 'test'").join(F.broadcast(best), ["scenario", "alpha_id", "split_id", "sign"], "left_semi")
    first = Window.partitionBy("scenario", "alpha_id", "datetime").orderBy("split_id")
    return pf.portfolio_summary(tested.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n"), ["scenario", "alpha_id"])


# -- allocation --------------------------------------------------------------------------------------------


def project_simplex(v: np.ndarray, cap: float = 1.0) -> np.ndarray:
    """The nearest point with non-negative parts of sum one, none above ``cap`` (or 1/n, where the cap can't hold)."""
    n = len(v)
    cap = max(cap, 1.0 / n)
    lo, hi = v.min() - 1.0, v.max()
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.clip(v - mid, 0, cap).sum() > 1 else (lo, mid)
    w = np.clip(v - hi, 0, cap)
    return w / w.sum()


def fit_allocation(returns: np.ndarray, penalty: float = 0.5, l2: float = 1e-6, turnover: float = 0.0, before: np.ndarray | None = None, cap: float = 1.0, metric: str = "information_ratio", steps: int = 200, rate: float = 0.1) -> np.ndarray:
    """Weights of the alphas from their returns (dates x alphas): projected gradient ascent over the capped simplex on

    s.w - penalty w'|C|w - l2 |w|^2 - turnover |w - before|^2, where s are the scores, none negative
    (all ones, if none is positive), and C is the correlation of the returns.
    """
    r = np.nan_to_num(returns)
    n = r.shape[1]
    mean, sd = r.mean(axis=0), r.std(axis=0, ddof=1) if len(r) > 1 else np.zeros(n)
    ir = np.where(sd > 0, mean / np.where(sd > 0, sd, 1.0), 0.0) * YEAR**0.5
    s = np.maximum(ir if metric == "information_ratio" else (1 + mean) ** YEAR - 1, 0.0)
    s = s if s.sum() > 0 else np.ones(n)
    z = np.where(sd > 0, (r - mean) / np.where(sd > 0, sd, 1.0), 0.0)
    c = np.abs(z.T @ z / max(len(r) - 1, 1))
    np.fill_diagonal(c, 1.0)
    values, vectors = np.linalg.eigh(c)
    c = (vectors * np.maximum(values, 1e-8)) @ vectors.T
    cap = cap if 0 < cap < 1 else 1.0
    if before is not None and np.maximum(np.nan_to_num(before), 0).sum() > 0:
        before = np.maximum(np.nan_to_num(before), 0)
        before = project_simplex(before / before.sum(), cap)
    else:
        before = None
    w = np.full(n, 1.0 / n) if before is None else before
    for _ in range(steps):
        anchor = w if before is None else before
        new = project_simplex(w + rate * (s - 2 * penalty * c @ w - 2 * l2 * w - 2 * turnover * (w - anchor)), cap)
        done, w = np.linalg.norm(new - w) <= 1e-8, new
        if done:
            break
    return w


def _fit(rows, names: list[str], cfg: dict) -> dict[str, float]:
    wide = rows.pivot(index="datetime", columns="alpha_id", values="x").reindex(columns=names).fillna(0.0)
    return dict(zip(names, fit_allocation(wide.to_numpy(), **cfg)))


def allocate(daily: DataFrame, labels: DataFrame | None = None, x: str = "net_return", min_days: int = 20, **cfg) -> DataFrame:
    """(label, alpha_id, weight): one allocation over all dates (label "global"), and one for each regime of enough dates."""
    names = sorted(r.alpha_id for r in daily.select("alpha_id").distinct().collect())
    rows = daily.select("datetime", "alpha_id", F.col(x).alias("x"), F.lit("global").alias("label"))
    if labels is not None:
        known = daily.join(labels.where("label is not null"), "datetime").select("datetime", "alpha_id", F.col(x).alias("x"), "label")
        enough = known.groupBy("label").agg(F.countDistinct("datetime").alias("n")).where(F.col("n") >= min_days)
        rows = rows.unionByName(known.join(enough, "label", "left_semi").select(rows.columns))

    def run(group):
        import pandas as pd

        w = _fit(group, names, cfg)
        return pd.DataFrame({"label": group["label"].iloc[0], "alpha_id": list(w), "weight": list(w.values())})

    return rows.groupBy("label").applyInPandas(run, "label string, alpha_id string, weight double")


def daily_weights(labels: list, by_label: dict[str, np.ndarray], fallback: np.ndarray, smoothing: float = 0.0, cap: float = 1.0) -> tuple[np.ndarray, float]:
    """The weights of each date (in order) by its label, smoothed in time and kept under the cap, and the share of dates that fell back."""
    cap = cap if 0 < cap < 1 else 1.0
    fallback = np.maximum(np.nan_to_num(fallback), 0.0)
    fallback = fallback / fallback.sum() if fallback.sum() > 0 else np.full(len(fallback), 1 / len(fallback))
    before, out, used = project_simplex(fallback, cap), [], 0
    for label in labels:
        target = by_label.get(label) if isinstance(label, str) else None
        used += target is None
        target = fallback if target is None else target
        before = project_simplex((1 - smoothing) * target + smoothing * before if smoothing else target, cap)
        out.append(before)
    return np.array(out).reshape(-1, len(fallback)), used / max(len(labels), 1)


def daily_allocation(allocation: DataFrame, labels: DataFrame, smoothing: float = 0.0, cap: float = 1.0) -> DataFrame:
    """(datetime, alpha_id, weight): each date's regime allocation (global, where it has none), smoothed in time and under the cap.

    One group: as many rows as there are dates; the allocation is as large as labels and alphas are.
    """
    table = allocation.toPandas().pivot(index="label", columns="alpha_id", values="weight").fillna(0.0)
    names, known = list(table.columns), {k: table.loc[k].to_numpy() for k in table.index}
    out = labels.select("datetime").schema.add("alpha_id", "string").add("weight", "double")

    def run(rows):
        rows = rows.sort_values("datetime")
        w, _ = daily_weights(list(rows["label"]), {k: v for k, v in known.items() if k != "global"}, known["global"], smoothing, cap)
        return pd.DataFrame({"datetime": np.repeat(rows["datetime"].to_numpy(), len(names)), "alpha_id": names * len(rows), "weight": w.reshape(-1)})

    return labels.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(run, out)


def allocated_returns(daily: DataFrame, weights: DataFrame, x: str = "net_return", turnover_bps: float = 0.0) -> DataFrame:
    """The allocated return of each date, less the cost of changing the allocation."""
    w = Window.partitionBy("alpha_id").orderBy("datetime")
    moved = weights.withColumn("_d", F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(w), "weight")))
    return daily.join(moved, ["datetime", "alpha_id"]).groupBy("datetime").agg(F.sum(F.col("weight") * F.col(x)).alias("gross"), (F.sum("_d") / 2).alias("alpha_turnover")).withColumn(x, F.col("gross") - F.col("alpha_turnover") * turnover_bps / 1e4)


def holdings_ensemble(held: DataFrame, alpha_weights: DataFrame | None = None) -> DataFrame:
    """Blended holdings (datetime, instrument, weight): equally over the alphas, or by given (static or daily) alpha weights."""
    if alpha_weights is None:
        n = held.select("alpha_id").distinct().count()
        return held.groupBy("datetime", "instrument").agg((F.sum("weight") / max(n, 1)).alias("weight"))
    on = ["datetime", "alpha_id"] if "datetime" in alpha_weights.columns else ["alpha_id"]
    return held.join(alpha_weights.withColumnRenamed("weight", "_a"), on).groupBy("datetime", "instrument").agg(F.sum(F.col("weight") * F.col("_a")).alias("weight"))


# -- optimizer ------------------------------------------------------------------------------------------------


def optimized_targets(targets: DataFrame, factors: DataFrame, exposure: DataFrame, columns: list[str], keys: list[str], opt: Optimizer | None = None, most: float = 0.0) -> DataFrame:
    """Weights of each date's target sides by the optimizer, each date by itself: one group of candidates per key and date.

    Scores are standardized; without weights, the date keeps the targets' own.
    """
    opt = opt or Optimizer(backend="ridge", l2=1e-3, exposure=1.0, risk=1.0)
    rows = targets.join(factors.select(*keys, "datetime", "instrument", "value"), [*keys, "datetime", "instrument"]).join(exposure.select("datetime", "instrument", *columns, F.pow("volatility", 2).alias("_var")), ["datetime", "instrument"], "left")
    schema = targets.schema

    def run(g):
        score, var = g["value"].to_numpy(float), g["_var"].to_numpy(float)
        sd = score.std()
        score = (score - score.mean()) / sd if sd > 0 else score * 0
        known = var[np.isfinite(var)]
        w, _ = optimize(score, np.sign(g["weight"].to_numpy(float)), np.zeros(len(g)), g[columns].to_numpy(float), opt, most, {"variance": var / max(known.mean(), 1e-12) if len(known) else None})
        if w is not None:
            g["weight"] = w
        return g[[f.name for f in schema.fields]]

    return rows.groupBy(*keys, "datetime").applyInPandas(run, schema)


__all__ = ["END_TO_END", "Optimizer", "WalkForward", "allocate", "allocated_returns", "best_schedule", "chosen_signs", "constrain", "correlation_summary", "daily_allocation", "daily_weights", "end_to_end_ablation", "equal_weight_ensemble", "factor_risk_model", "feasible", "fit_allocation", "goodness", "greedy_diverse", "holdings_ensemble", "in_segments", "knee", "optimized_targets", "out_of_sample", "pareto", "project_simplex", "quality_gates", "return_correlations", "ridge_weights", "schedule_pairs", "schedule_sweep", "segments", "select_diverse", "selectable", "splits", "stability", "summarize", "sweep", "thin", "top_k", "tune_selection", "utility", "valid_candidates", "walk_forward"]
