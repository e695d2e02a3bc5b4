"""Ardoise: a PySpark-native analytics engine for public contract awards."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers by value: a cluster needs no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
