"""Operators for preparing training data: scoring, near-duplicates, archives, extraction, mixing, filters, formatting."""

import sys

from pyspark import cloudpickle

# functions travel to the executors with their code, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
