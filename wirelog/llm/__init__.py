"""Operators of a training-data pipeline; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Functions travel to the tasks by value: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
