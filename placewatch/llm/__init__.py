"""Operators for preparing large text corpora. Nothing else in the package imports this folder."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
