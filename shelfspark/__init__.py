"""Catalogue analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# The functions of Arrow and pandas operators travel to the executors by value, so the
# workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
