"""Operators for preparing training text, each with its own query and tests."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: these need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
