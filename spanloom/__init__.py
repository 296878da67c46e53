"""Interval, score-timeline and corpus analytics on Spark DataFrames.

Functions that run on executors are pickled by value, as executors need not have this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
