"""Operators for training-data pipelines. Nothing else in the package imports them."""

import sys

from pyspark import cloudpickle

# Tasks get this subpackage's functions by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
