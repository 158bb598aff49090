"""Spark-native raster, document and corpus analytics.

Functions of this package that end up in Python workers are pickled by value,
so a job needs no copy of the package on the executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
