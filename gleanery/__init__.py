"""Listing extraction, catalogue and search as Spark jobs."""

import sys

from pyspark import cloudpickle

# Helpers that run in Python workers travel with the job, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
