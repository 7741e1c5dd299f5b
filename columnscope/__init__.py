"""Analysis of one table of any size, expressed as Spark DataFrame and SQL jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
