"""Spark-native analytics over service requests: contracts, marts, anomaly detectors, evaluation, serving."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers are shipped by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
