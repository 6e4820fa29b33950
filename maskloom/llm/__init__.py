"""Operators for preparing training text: scans, extraction, search, near duplicates, packing."""

import sys

from pyspark import cloudpickle

# Functions of this package go to the executors by value, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
