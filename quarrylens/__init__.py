"""A PySpark-native engine that analyses legacy systems as tables, graphs and rules.

Python functions that run on executors are shipped by value, so that workers
need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
