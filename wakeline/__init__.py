"""Vessel-position analytics on PySpark: DataFrame in, DataFrame out."""

import sys

from pyspark import cloudpickle

# Task-side helpers travel by value, so executors do not need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
