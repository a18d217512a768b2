"""Operators for training-data pipelines. Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# functions travel to the executors by value, so these need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
