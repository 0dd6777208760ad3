"""Endpoint security-log analytics as composable Spark DataFrame functions."""

import sys

from pyspark import cloudpickle

# Python workers receive the few Arrow functions of this package by value, so
# executors need nothing but PySpark, numpy and pandas installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
