"""strataline: DataFrame-first engine for legacy-table migration and checking."""

import sys

from pyspark import cloudpickle

__version__ = "0.2.0"

# Worker functions and data sources travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
