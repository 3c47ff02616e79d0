"""Privacy-risk and data-quality profiling of tables and text corpora on Spark."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with their code, so executors do
# not need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
