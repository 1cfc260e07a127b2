"""Operators for large text corpora. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the executors by value: no files to install there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
