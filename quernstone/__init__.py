"""Quernstone: retrieval, pricing, ledger and text analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Worker processes get the package's functions by value, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
