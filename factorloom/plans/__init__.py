"""The factor language: parsing, checks, rewrites and compilation to DataFrames."""

from .compiler import compile_factors, eval_factor, run_factors
from .language import FactorError, allowed_columns, allowed_functions, autofix, critique, parse
from .safety import scan_code

__all__ = ["FactorError", "allowed_columns", "allowed_functions", "autofix", "compile_factors", "critique", "eval_factor", "parse", "run_factors", "scan_code"]
