"""Spark-native analytics over document packets and page streams."""

import sys

from pyspark import cloudpickle

# tasks carry the package's functions with them: executors need not have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
