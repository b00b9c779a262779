"""veriglot: auditing the translation quality of web text with Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions sent to executors travel by value, so that no executor needs this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
