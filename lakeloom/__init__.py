"""Metadata record linkage and near-duplicate detection as Spark plans."""

import sys

from pyspark import cloudpickle

# Executors receive the package's functions by value, so a job needs no copy of it on the workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
