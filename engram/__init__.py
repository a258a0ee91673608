"""Conversation and context analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Python workers get this package's functions with the job and need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
