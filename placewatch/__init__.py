"""Place-based risk analytics on Spark: batch history, spatial joins, rollups, search."""

import sys

from pyspark import cloudpickle

# Functions that run in Python tasks travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
