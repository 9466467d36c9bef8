"""Leakage-safe sequence, federated and stream analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job: a worker, above all the one that sets
# up streaming state, need not have this package on its import path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
