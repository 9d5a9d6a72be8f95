"""Operators of training-data pipelines. Nothing else in the library imports this subpackage.

Python functions that run on executors are shipped by value, so a cluster needs
no copy of this package on its workers.
"""

from pyspark import cloudpickle

import quarrylens.llm as _self

cloudpickle.register_pickle_by_value(_self)
