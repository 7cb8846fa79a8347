"""A Spark-first engine for collections of dated texts with recurring subjects.

Functions that run in Python workers are shipped by value, so executors need
NumPy, pyarrow and xxhash but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
