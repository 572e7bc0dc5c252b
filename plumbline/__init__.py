"""plumbline: drawing-data analytics and corpus operators on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
