"""Symbol index, symbol search, context assembly and edit streams as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the tasks by value: the workers need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
