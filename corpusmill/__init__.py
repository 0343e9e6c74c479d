"""Product-document corpora on Spark: ingest, index, hybrid search, answers."""

import sys

from pyspark import cloudpickle

# Functions sent to the executors travel by value, so this package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
