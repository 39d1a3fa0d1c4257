"""Sharded-table analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors need not have the package installed: its functions travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
