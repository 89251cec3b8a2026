"""tablesight: tables, charts' data, text search and run metrics as Spark DataFrames."""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions sent to tasks travel with their code, so executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
