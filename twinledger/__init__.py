"""Reconciliation of two order-execution feeds, and corpus preparation, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so workers need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
