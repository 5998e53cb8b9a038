"""Retail operations analytics as PySpark DataFrame functions."""

import sys

from pyspark import cloudpickle

from storelens.api import ALIASES, FUNCTIONS, call

# The few helpers that run inside Python tasks travel with them, so executors need
# no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["ALIASES", "FUNCTIONS", "call"]
