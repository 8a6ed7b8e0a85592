"""Operators for preparing training data, one module each, and their queries.

Functions of this package that run in tasks are sent by value, so that executors
need not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
