"""Density clustering and the query operators around it, on the PySpark DataFrame API."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the query, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
