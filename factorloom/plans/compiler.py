"""Compiles factor expressions to staged DataFrames.

A node's level is the number of window stages below it.  All window nodes of one level, of all
factors of the batch, become columns of one stage: those per instrument share one partitioning,
those per date another, so a batch costs one shuffle per change of partitioning and level.
Element-wise nodes are never materialised; they are part of the expressions above them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as fn
from ..functions import linear
from . import scans
from .language import FUNCTIONS, FactorError, parse

def _rows_in_time():
    return Window.partitionBy("instrument").orderBy("datetime")

def _on_date():
    return Window.partitionBy("datetime")

EPS = 1e-12
#: Share of missing values above which a factor is refused.
MAX_MISSING = 0.95


def _kind(node: tuple) -> str:
    return FUNCTIONS[node[1]][0] if node[0] == "call" else "el"


class _Plan:
    def __init__(self):
        self.levels: dict[tuple, int] = {}
        self.names: dict[tuple, str] = {}

    def level(self, node: tuple) -> int:
        known = self.levels.get(node)
        if known is None:
            below = max((self.level(a) for a in node[1:] if isinstance(a, tuple)), default=0)
            known = self.levels[node] = below + (_kind(node) != "el")
            if _kind(node) != "el":
                self.names[node] = f"_f{len(self.names)}"
        return known

    def column(self, node: tuple) -> Column:
        """The node as an expression over the columns of the stages below."""
        tag = node[0]
        if tag == "lit":
            return F.lit(node[1]) if isinstance(node[1], bool) else F.lit(float(node[1]))
        if tag == "col":
            return F.col(node[1])
        if node in self.names:
            return F.col(self.names[node])
        if tag == "op":
            return self._operator(node)
        return self._element(node)

    def number(self, node: tuple) -> Column:
        c = self.column(node)
        return c.cast("double") if _is_boolean(node) else c

    def truth(self, node: tuple) -> Column:
        return self.column(node) if _is_boolean(node) else F.coalesce(self.column(node) != 0, F.lit(True))

    def _operator(self, node: tuple) -> Column:
        op = node[1]
        if op in ("and", "or"):
            a, b = self.truth(node[2]), self.truth(node[3])
            return a & b if op == "and" else a | b
        if op == "not":
            return ~self.truth(node[2])
        if op == "neg":
            return -self.number(node[2])
        a, b = self.number(node[2]), self.number(node[3])
        if op in ("<", "<=", ">", ">=", "==", "!="):
            return fn.compare(op, a, b)
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: fn.div(a, b), "%": lambda: fn.floor_mod(a, b), "**": lambda: fn.power(a, b)}[op]()

    def _element(self, node: tuple) -> Column:
        name, args = node[1], node[2:]
        if name == "where":
            return F.when(self.truth(args[0]), self.number(args[1])).otherwise(self.number(args[2]))
        x = self.number(args[0])
        if name == "clip":
            return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(args[1][1]))), F.lit(float(args[2][1]))))
        if name == "safe_div":
            return x / (F.abs(self.number(args[1])) + F.lit(float(args[2][1])))
        if name in ("maximum", "minimum"):
            return (fn.greatest if name == "maximum" else fn.least)(x, self.number(args[1]))
        return {"log": F.ln, "log1p": F.log1p, "sqrt": fn.sqrt, "abs": F.abs, "sign": F.signum}[name](x)

    def window(self, node: tuple) -> Column:
        """A window node as one expression."""
        name, args = node[1], node[2:]
        x = self.number(args[0])
        if _kind(node) == "ts":
            return _in_time(name, x, self.number(args[1]) if name == "ts_corr" else None, int(args[-1][1]))
        if name == "cs_rank":
            same = Window.partitionBy("datetime", x)
            place = F.rank().over(_on_date().orderBy(x.asc_nulls_last())) + (F.count(x).over(same) - 1) / 2
            return F.when(x.isNotNull(), place / F.count(x).over(_on_date()))
        if name == "cs_demean":
            return x - F.avg(x).over(_on_date())
        if name == "cs_demean_group":
            return x - F.avg(x).over(_group(self.column(args[1])))
        if name == "zscore":
            return fn.div(x - F.avg(x).over(_on_date()), F.stddev_pop(x).over(_on_date()))
        if name == "winsorize":
            limit = float(args[1][1])
            low, high = (F.percentile(x, F.lit(q)).over(_on_date()) for q in (limit, 1 - limit))
            return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))
        if name == "scale":
            return fn.div(x, F.sum(F.abs(x)).over(_on_date()))
        controls = args[2:] if name == "cs_neutralize_group" else args[1:]
        by = _group(self.column(args[1])) if name == "cs_neutralize_group" else _on_date()
        if not controls:
            return x - F.avg(x).over(by)
        z = self.number(controls[0])
        both = x.isNotNull() & z.isNotNull()
        x, z = F.when(both, x), F.when(both, z)
        n, slope = F.count(x).over(by), F.coalesce(fn.div(F.covar_pop(x, z).over(by), F.var_pop(z).over(by)), F.lit(0.0))
        return F.when(n > 2, x - F.avg(x).over(by) - slope * (z - F.avg(z).over(by)))


def _is_boolean(node: tuple) -> bool:
    return node[0] == "op" and node[1] in ("and", "or", "not", "<", "<=", ">", ">=", "==", "!=") or node[0] == "lit" and isinstance(node[1], bool)


def _group(g: Column):
    return Window.partitionBy("datetime", F.coalesce(g.cast("string"), F.lit("UNKNOWN")))


def _in_time(name: str, x: Column, y: Column | None, k: int) -> Column:
    if name in ("delay", "returns", "ts_delta"):
        if k == 0:
            return x if name == "delay" else x * 0.0
        before = F.lag(x, k).over(_rows_in_time())
        return {"delay": lambda: before, "returns": lambda: fn.div(x, before) - 1, "ts_delta": lambda: x - before}[name]()
    frame = _rows_in_time().rowsBetween(-(k - 1), 0)
    full = F.count(x).over(frame) == k
    if name == "ts_corr":
        both = x.isNotNull() & y.isNotNull()
        return F.when(F.count(F.when(both, x)).over(frame) == k, fn.correlation(x, y, frame))
    plain = {"ts_mean": F.avg, "ts_sum": F.sum, "ts_std": F.stddev_pop, "ts_min": F.min, "ts_max": F.max}
    if name in plain:
        return F.when(full, plain[name](x).over(frame))
    mean = F.when(full, F.avg(x).over(frame))
    if name == "ts_zscore":
        return fn.div(x - mean, F.stddev_pop(x).over(frame))
    if name == "rel_volume":
        return x / (F.abs(mean) + EPS)
    return scans.lagged(name, x, k)


def _inputs(df: DataFrame, nodes: list[tuple], plan: _Plan, work) -> DataFrame:
    """``work`` on the table with a column for each distinct input of the nodes; the columns go again."""
    names: dict[tuple, str] = {}
    for n in nodes:
        names.setdefault(n[2], f"_x{len(names)}")
    out = work(df.withColumns({c: plan.number(x).cast("double") for x, c in names.items()}), [(names[n[2]], plan.names[n], n[1], int(n[3][1])) for n in nodes])
    return out.drop(*names.values())


def _decays(df: DataFrame, todo: list[tuple]) -> DataFrame:
    return scans.decays(df.withColumns({x: fn.scrub(F.col(x)) for x, *_ in todo}), [(x, o, k) for x, o, _, k in todo])


def _regressions(df: DataFrame, nodes: list[tuple], plan: _Plan) -> DataFrame:
    """Residuals on two or more controls and a constant, for each date (and group).

    Rows with a missing term take no part; with no more rows than terms there is no residual.
    """
    kept = df.columns
    for i, n in enumerate(nodes):
        grouped = n[1] == "cs_neutralize_group"
        terms = [n[2], *n[4:]] if grouped else [n[2], *n[3:]]
        names = [f"_r{i}_{j}" for j in range(len(terms))]
        columns = {c: fn.scrub(plan.number(t).cast("double")) for c, t in zip(names, terms)}
        by = ["datetime"]
        if grouped:
            columns[f"_r{i}_g"] = F.coalesce(plan.column(n[3]).cast("string"), F.lit("UNKNOWN"))
            by.append(f"_r{i}_g")
        df = df.withColumns(columns)
        y, *xs = [F.col(c) for c in names]
        whole = F.lit(True)
        for c in (y, *xs):
            whole = whole & c.isNotNull()
        # rows that lack a term take no part: none of their terms does
        own, over = [F.when(whole, c) for c in (y, *xs)], Window.partitionBy(*by)
        df = linear.coefficients(df, own[1:], own[0], over, F.covar_pop)
        fit = sum((F.col("_coef")[j] * (x - F.avg(x).over(over)) for j, x in enumerate(own[1:])), F.avg(own[0]).over(over))
        kept = [*kept, plan.names[n]]
        df = df.withColumn(plan.names[n], F.when(F.count(own[0]).over(over) > len(terms), own[0] - fit)).select(*kept)
    return df


#: Functions with forms for large windows, by ``scans``.
_SCANNED = ("ts_rank", "ts_argmax", "ts_argmin", "ts_decay_linear")


def _scan_of(node: tuple):
    """What adds a node's column, if it is not a window expression."""
    if _kind(node) == "rec":
        return scans.exponential
    if node[1] in _SCANNED and node[3][1] > scans.SMALL:
        return _decays if node[1] == "ts_decay_linear" else scans.sliding
    return None


def compile_factors(panel: DataFrame, factors: dict[str, str], extras: tuple[str, ...] = (), also: tuple[str, ...] = ()) -> DataFrame:
    """The panel's keys, its columns ``also``, and one column for each factor; infinities and NaN are NULL."""
    plan = _Plan()
    nodes = {name: parse(text, extras) for name, text in factors.items()}
    top = max(plan.level(n) for n in nodes.values())
    df = panel
    for level in range(1, top + 1):
        own = [n for n in plan.names if plan.levels[n] == level]
        several = [n for n in own if n[1] in ("cs_neutralize", "cs_neutralize_group") and len(n) > (5 if n[1].endswith("group") else 4)]
        scanned = {n: scan for n in own if (scan := _scan_of(n))}
        for kind in ("ts", "cs"):
            some = [n for n in own if _kind(n) == kind and n not in several and n not in scanned]
            if some:
                hidden = {n: plan.names.pop(n) for n in some}
                made = {hidden[n]: plan.window(n) for n in some}
                plan.names |= hidden
                df = df.withColumns(made)
        for scan in dict.fromkeys(scanned.values()):
            df = _inputs(df, [n for n in scanned if scanned[n] is scan], plan, scan)
        if several:
            df = _regressions(df, several, plan)
    return df.select("datetime", "instrument", *also, *(fn.scrub(plan.number(n)).alias(name) for name, n in nodes.items()))


def eval_factor(panel: DataFrame, text: str, name: str = "value", extras: tuple[str, ...] = ()) -> DataFrame:
    return compile_factors(panel, {name: text}, extras)


@dataclass(frozen=True)
class FactorRun:
    """Long values (alpha_id, datetime, instrument, value) and the factors that were refused, with the reason."""

    values: DataFrame | None
    errors: dict[str, str]


def run_factors(panel: DataFrame, alphas: list[dict], extras: tuple[str, ...] = (), max_missing: float = MAX_MISSING, also: tuple[str, ...] = (), deal: str | None = None) -> FactorRun:
    """All valid factors of a batch in one plan; those with too many missing values are refused after one aggregate pass.

    ``also``: columns of the panel that the values keep.  ``deal``: a key by which the rows are dealt while
    they are wide, one for all factors.
    """
    factors, errors = {}, {}
    for a in alphas:
        name = next((a[k] for k in ("alpha_id", "alphaID", "id") if a.get(k)), None)
        text = a.get("dsl") or a.get("expression")
        if not name:
            continue
        if not text:
            errors[name] = "ExecutionError: no expression (Python code is not executed)"
            continue
        try:
            parse(text, extras)
            factors[name] = text
        except FactorError as e:
            errors[name] = f"DSLValidationError: {e}"
    if not factors:
        return FactorRun(None, errors)
    wide = compile_factors(panel, factors, extras, also)
    wide = wide.repartition(deal) if deal else wide
    if max_missing >= 1:  # nothing can be refused, so there is nothing to look at
        return FactorRun(long_form(wide, list(factors), also), errors)
    share = wide.agg(*[F.avg(F.col(f"`{n}`").isNull().cast("double")).alias(n) for n in factors]).first()
    for n in list(factors):
        if share[n] is None or share[n] > max_missing:
            errors[n] = "ExecutionError: too many missing values"
    good = [n for n in factors if n not in errors]
    return FactorRun(long_form(wide, good, also) if good else None, errors)


def long_form(wide: DataFrame, names: list[str], also: tuple[str, ...] = ()) -> DataFrame:
    """(alpha_id, datetime, instrument, value) of the wide factor columns, and the columns ``also``."""
    pairs = F.array(*[F.struct(F.lit(n).alias("alpha_id"), F.col(f"`{n}`").alias("value")) for n in names])
    return wide.select("datetime", "instrument", *also, F.explode(pairs).alias("p")).select("p.alpha_id", "datetime", "instrument", "p.value", *also)
