"""Liquidation analytics for leveraged markets, written as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Ship the few Python functions that run in tasks by value, so workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
