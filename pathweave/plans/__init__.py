"""Path expressions: parsing, rewriting, evaluation."""

from .executor import Solver, run_workload
from .parser import PathSyntaxError, parse_path, parse_query

__all__ = ["PathSyntaxError", "Solver", "parse_path", "parse_query", "run_workload"]
