"""Operators of a training-data pipeline over documents, pages and embeddings."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers by value: executors need the
# libraries they use, but not this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
