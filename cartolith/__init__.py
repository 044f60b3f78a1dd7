"""cartolith: exposure-aware routing over street data, on PySpark DataFrames."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions travel to the executors by value, so workers need no copy of the
# package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
