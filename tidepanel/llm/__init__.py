"""Operators of a training-data pipeline. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Ship this package's functions with each job; executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
