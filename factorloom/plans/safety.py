"""Static scan of user Python code.  The engine itself never executes such code.

The scan is an allow-list: modules that may be imported, builtins that may be called, and no private
names, loops without an end, or names that read or write anything.
"""

from __future__ import annotations

import ast

#: Modules that may be imported.
MODULES = frozenset({"math", "numpy", "pandas"})
#: Builtins that may be used; every other one is refused.
BUILTINS = frozenset({"abs", "all", "any", "bool", "dict", "enumerate", "filter", "float", "int", "isinstance", "len", "list", "map", "max", "min", "pow", "range", "reversed", "round", "set", "slice", "sorted", "str", "sum", "tuple", "zip", "ArithmeticError", "Exception", "IndexError", "KeyError", "TypeError", "ValueError", "ZeroDivisionError", "print", "super"})
#: Beginnings of attributes that read or write, and whole names that do; ``io`` is a namespace of readers.
IO_PREFIXES = ("read_", "to_", "from", "load", "save", "dump", "memmap", "open")
IO_EXCEPT = frozenset({"to_numpy", "to_frame", "to_list", "to_series", "to_datetime", "to_numeric", "to_timedelta", "to_dict", "to_period", "to_timestamp", "from_dict", "from_records", "fromkeys"})
IO_NAMES = frozenset({"io", "tofile", "ctypeslib", "f2py", "DataSource", "HDFStore", "ExcelFile", "ExcelWriter", "genfromtxt", "eval", "query", "pipe"})
#: Names of modules that may not even be mentioned.
WORDS = frozenset("os sys subprocess socket shutil pathlib requests urllib http ftplib importlib builtins pickle marshal ctypes".split())
MAX_CODE_CHARS = 20_000


def _reads_or_writes(name: str) -> bool:
    return name in IO_NAMES or name.startswith(IO_PREFIXES) and name not in IO_EXCEPT


def scan_code(code: str) -> list[str]:
    """Reasons to refuse the code; an empty list if there are none."""
    if not (code or "").strip():
        return ["no code"]
    if len(code) > MAX_CODE_CHARS:
        return ["code is too long"]
    try:
        tree = ast.parse(code)
    except SyntaxError as e:
        return [f"syntax: {e.msg}"]
    import builtins

    out = []
    for x in ast.walk(tree):
        if isinstance(x, ast.While):
            out.append("while loop")
        elif isinstance(x, (ast.Import, ast.ImportFrom)):
            names = [a.name for a in x.names] if isinstance(x, ast.Import) else [x.module or ""]
            out += [f"import {n}" for n in names if n.split(".")[0] not in MODULES]
            out += [f"import {a.name}" for a in x.names if isinstance(x, ast.ImportFrom) and _reads_or_writes(a.name)]
        elif isinstance(x, ast.Attribute) and (x.attr.startswith("__") or _reads_or_writes(x.attr) or x.attr in WORDS):
            out.append(f"attribute {x.attr}")
        elif isinstance(x, ast.Name) and (x.id.startswith("__") or x.id in WORDS or hasattr(builtins, x.id) and x.id not in BUILTINS):
            out.append(f"name {x.id}")
    return out
