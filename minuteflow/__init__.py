"""minuteflow: meeting-record retrieval, graph and grounded question answering on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel by value: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
