"""Corpus preparation and batch retrieval on Spark DataFrames.

``functions``  Column expressions: ids, text extraction, packing, rule detection
``operators``  DataFrame -> DataFrame: chunkers, vector search, ranking, statistics
``sources``    scans of files and landed JSON, chunk tables, serving export
``streaming``  high-water-mark sync and micro-batch upsert
``plans``      compositions: batch analysis, context assembly, evaluation, registry
"""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel whole, so executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
