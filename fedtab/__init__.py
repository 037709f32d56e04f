"""fedtab: federated tabular analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the task, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
