"""lumenframe: document analytics, retrieval and training-data preparation on Spark DataFrames."""

from pyspark import cloudpickle as _cloudpickle

import lumenframe as _self

# Functions of this package travel to executors by value, so a cluster needs no copy of it on its workers.
_cloudpickle.register_pickle_by_value(_self)
