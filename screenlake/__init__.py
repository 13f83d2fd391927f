"""screenlake: literature screening and corpus preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value: executors need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
