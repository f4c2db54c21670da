"""broadloom: feature tables, folds, out-of-fold regression and stacking as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers by value: executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
