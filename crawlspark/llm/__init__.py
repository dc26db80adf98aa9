"""Operators for training-data pipelines. Nothing else in the library imports this subpackage.

Functions that run inside tasks are sent to the executors by value, so the executors do
not need this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
