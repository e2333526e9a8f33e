"""Score, compare, calibrate and price probabilistic answers as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry this package's code, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
