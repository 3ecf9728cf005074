"""Incremental Datalog analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from .operators.zframe import ZFrame
from .plans.compiler import compile_query, run_query
from .plans.parser import parse_query
from .sources.catalog import AttributeCatalog
from .streaming.view import View

__all__ = ["AttributeCatalog", "View", "ZFrame", "compile_query", "parse_query", "run_query"]

# Functions that run on executors travel by value, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
