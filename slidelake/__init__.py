"""Slide pyramids, tile stores, viewports, annotations and tile analysis as Spark DataFrame jobs.

Every operator takes DataFrames and returns DataFrames over many slides at
once.  See ``operators`` for the algebra, ``sources`` for readers and writers,
``functions`` for scalar column helpers, ``streaming`` for continuous forms and
``plans`` for multi-operator pipelines.
"""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value, so that executors need no
# copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
