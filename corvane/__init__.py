"""corvane: retrieval, ranking and corpus-preparation operators declared on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions shipped to executors travel by value, so a cluster needs no copy of the package on its workers' path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
