"""Expressions of the factor language as hash-consed nodes.

The syntax is a subset of Python expressions.  A node is a tuple: ("lit", value), ("col", name),
("call", function, *args), ("op", operator, *args).  Equal subexpressions are equal tuples, so all
factors of a batch share them.
"""

from __future__ import annotations

import ast
import re
from functools import lru_cache

#: Limits of the language.
MAX_NODES, MAX_WINDOW, MAX_LAG, MAX_CHARS = 300, 1000, 1000, 5000
COLUMNS = ("open", "high", "low", "close", "volume", "sector")

#: function -> (kind, series arguments (None: any), integer/number arguments, of which optional)
#: kinds: ts = per instrument in time, cs = per date, el = element-wise, rec = recursive in time
FUNCTIONS = {
    "delay": ("ts", 1, 1, 0), "returns": ("ts", 1, 1, 1), "ts_delta": ("ts", 1, 1, 1),
    "ts_mean": ("ts", 1, 1, 0), "sma": ("ts", 1, 1, 0), "ts_sum": ("ts", 1, 1, 0), "ts_std": ("ts", 1, 1, 0),
    "ts_zscore": ("ts", 1, 1, 0), "rel_volume": ("ts", 1, 1, 0), "ts_min": ("ts", 1, 1, 0), "ts_max": ("ts", 1, 1, 0),
    "ts_rank": ("ts", 1, 1, 0), "ts_corr": ("ts", 2, 1, 0), "ts_argmax": ("ts", 1, 1, 0), "ts_argmin": ("ts", 1, 1, 0),
    "ts_decay_linear": ("ts", 1, 1, 0), "ewm_mean": ("rec", 1, 1, 0), "ewm_std": ("rec", 1, 1, 0),
    "cs_rank": ("cs", 1, 0, 0), "rank": ("cs", 1, 0, 0), "cs_demean": ("cs", 1, 0, 0), "cs_demean_group": ("cs", 2, 0, 0),
    "zscore": ("cs", 1, 0, 0), "cs_neutralize": ("cs", None, 0, 0), "cs_neutralize_group": ("cs", None, 0, 0),
    "winsorize": ("cs", 1, 1, 1), "scale": ("cs", 1, 0, 0),
    "clip": ("el", 1, 2, 0), "log": ("el", 1, 0, 0), "log1p": ("el", 1, 0, 0), "sqrt": ("el", 1, 0, 0), "abs": ("el", 1, 0, 0),
    "abs_": ("el", 1, 0, 0), "sign": ("el", 1, 0, 0), "where": ("el", 3, 0, 0), "maximum": ("el", 2, 0, 0), "minimum": ("el", 2, 0, 0),
    "safe_div": ("el", 2, 1, 1),
}
ALIASES = {"sma": "ts_mean", "rank": "cs_rank", "abs_": "abs"}
DEFAULTS = {"returns": (1,), "ts_delta": (1,), "winsorize": (0.01,), "safe_div": (1e-12,)}
_BINARY = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Mod: "%", ast.Pow: "**"}
_COMPARE = {ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Eq: "==", ast.NotEq: "!="}
_FOLD = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b, "%": lambda a, b: a % b, "**": lambda a, b: a**b}


class FactorError(ValueError):
    """An expression that the language does not allow."""


def allowed_functions() -> list[str]:
    return sorted(FUNCTIONS)


def allowed_columns() -> list[str]:
    return sorted(COLUMNS)


def _number(node, what: str):
    if node[0] != "lit" or isinstance(node[1], bool):
        raise FactorError(f"{what} must be a number")
    return node[1]


def _call(name: str, args: list) -> tuple:
    if name not in FUNCTIONS:
        raise FactorError(f"unknown function: {name}")
    kind, series, numbers, optional = FUNCTIONS[name]
    name = ALIASES.get(name, name)
    if series is None:
        if len(args) < (2 if name.endswith("group") else 1):
            raise FactorError(f"{name}: too few arguments")
        return ("call", name, *args)
    given = len(args) - series
    if not numbers - optional <= given <= numbers:
        raise FactorError(f"{name}: {series} series and {numbers - optional} to {numbers} numbers expected")
    values = [_number(a, f"{name}: argument") for a in args[series:]]
    values += list(DEFAULTS.get(name, ()))[len(values) :]
    if kind in ("ts", "rec"):
        if values[0] != int(values[0]):
            raise FactorError(f"{name}: window or lag must be whole")
        values[0] = int(values[0])
        lag = name in ("delay", "returns", "ts_delta")
        if not (0 if lag else 1) <= values[0] <= (MAX_LAG if lag else MAX_WINDOW):
            raise FactorError(f"{name}: window or lag out of range")
    if name == "winsorize" and not 0 <= values[0] < 0.5:
        raise FactorError("winsorize: limit must be in [0, 0.5)")
    return ("call", name, *args[:series], *(("lit", v) for v in values))


def _node(x: ast.AST, names: frozenset) -> tuple:
    if isinstance(x, ast.Expression):
        return _node(x.body, names)
    if isinstance(x, ast.Constant) and isinstance(x.value, (int, float, bool)):
        return ("lit", x.value)
    if isinstance(x, ast.Name):
        if x.id in FUNCTIONS or x.id not in names:
            raise FactorError(f"unknown name: {x.id}")
        return ("col", x.id)
    if isinstance(x, ast.Call):
        if not isinstance(x.func, ast.Name):
            raise FactorError("only named functions can be called")
        if x.keywords:
            raise FactorError(f"{x.func.id}: keyword arguments are not allowed")
        return _call(x.func.id, [_node(a, names) for a in x.args])
    if isinstance(x, ast.BinOp) and type(x.op) in _BINARY:
        op, a, b = _BINARY[type(x.op)], _node(x.left, names), _node(x.right, names)
        if a[0] == b[0] == "lit":
            try:
                return ("lit", _FOLD[op](a[1], b[1]))
            except ArithmeticError as e:
                raise FactorError(str(e)) from None
        return ("op", op, a, b)
    if isinstance(x, ast.UnaryOp) and isinstance(x.op, (ast.USub, ast.UAdd, ast.Not)):
        a = _node(x.operand, names)
        if isinstance(x.op, ast.UAdd):
            return a
        if isinstance(x.op, ast.Not):
            return ("lit", not a[1]) if a[0] == "lit" else ("op", "not", a)
        return ("lit", -a[1]) if a[0] == "lit" else ("op", "neg", a)
    if isinstance(x, ast.Compare):
        if len(x.ops) != 1 or type(x.ops[0]) not in _COMPARE:
            raise FactorError("chained or unknown comparison")
        return ("op", _COMPARE[type(x.ops[0])], _node(x.left, names), _node(x.comparators[0], names))
    if isinstance(x, ast.BoolOp):
        op, out = "and" if isinstance(x.op, ast.And) else "or", _node(x.values[0], names)
        for v in x.values[1:]:
            out = ("op", op, out, _node(v, names))
        return out
    raise FactorError(f"not allowed: {type(x).__name__}")


def has_column(node: tuple) -> bool:
    return node[0] == "col" or any(isinstance(a, tuple) and has_column(a) for a in node[1:])


@lru_cache(maxsize=1024)
def parse(text: str, extras: tuple[str, ...] = ()) -> tuple:
    """The checked node of an expression; ``extras`` are further column names."""
    if len(text) > MAX_CHARS:
        raise FactorError("expression is too long")
    clash = set(extras) & (set(COLUMNS) - {"sector"} | set(FUNCTIONS))
    if clash:
        raise FactorError(f"reserved names: {', '.join(sorted(clash))}")
    try:
        tree = ast.parse(text.strip(), mode="eval")
    except SyntaxError as e:
        raise FactorError(f"syntax: {e.msg}") from None
    if sum(1 for _ in ast.walk(tree)) > MAX_NODES:
        raise FactorError("expression has too many parts")
    node = _node(tree, frozenset(COLUMNS) | frozenset(extras))
    if not has_column(node):
        raise FactorError("expression has no series")
    return node


_RAW_VOLUME = re.compile(r"ts_mean\s*\(\s*volume\s*,\s*(\d+)\s*\)")


#: Forms of volume that have no scale of their own.
_SCALED = re.compile(r"ts_rank\(volume|rel_volume\(volume|ts_zscore\(|log1p\(volume")


def critique(text: str) -> list[str]:
    """Warnings on scale: raw volume multiplied with returns, the logarithm of a volume that may be zero, and factors without cross-sectional scaling."""
    out, e = [], text.replace(" ", "")
    if "returns(" in e and re.search(r"ts_mean\(volume|\*volume|volume\*", e) and not _SCALED.search(e):
        out.append("raw volume multiplied with returns: use a rank, a ratio or a z-score of volume")
    if "log(volume" in e and "log1p(volume" not in e:
        out.append("the logarithm of a volume of zero is missing: use log1p")
    if not re.search(r"\b(zscore|cs_rank|rank|scale|cs_demean|winsorize|cs_neutralize)\w*\(", text):
        out.append("no cross-sectional scaling: wrap the factor in zscore or rank")
    return out


def autofix(text: str) -> tuple[str, list[str]]:
    """Rewrites raw volume averages that meet returns to z-scores of log volume, unless volume is scaled already; the text and what was done."""
    e = text.replace(" ", "")
    if "returns(" not in e or "*" not in e or re.search(r"ts_zscore|ts_rank\(volume|rel_volume\(volume", e) or not _RAW_VOLUME.search(text):
        return text, []
    fixed = _RAW_VOLUME.sub(r"ts_zscore(log1p(volume), \1)", text)
    return fixed, ["ts_mean(volume, w) -> ts_zscore(log1p(volume), w)"]
