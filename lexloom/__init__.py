"""A Spark-native engine for searching, ranking and analysing text and source code."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
