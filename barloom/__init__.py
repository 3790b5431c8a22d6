"""Candle, swing and trade-ledger analytics on Spark DataFrames.

Functions of this package travel to Python workers by value, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
