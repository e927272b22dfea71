"""Spark-native engine for retrieval corpora: ingest, clean, chunk, rank and evaluate as DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so a cluster needs no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
