"""Fragment-pattern analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Arrow functions travel to the executors by value: nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
