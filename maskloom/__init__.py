"""Text anonymization on Spark: masking by salted tokens, and reports about it."""

import sys

from pyspark import cloudpickle

from maskloom.config import MaskConfig, generate_salt
from maskloom.operators.masking import mask_columns, mask_line, mask_text
from maskloom.operators.reports import findings

# Functions of this package go to the executors by value, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["MaskConfig", "findings", "generate_salt", "mask_columns", "mask_line", "mask_text"]
