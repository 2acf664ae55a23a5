"""treelens: a PySpark-native engine for whole-project questions over Python source trees."""

import sys

from pyspark import cloudpickle

# functions go to the executors by value, so that these need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
