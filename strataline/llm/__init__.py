"""Operators for training-data pipelines; nothing outside this subpackage imports it."""

from pyspark import cloudpickle

import strataline.llm as _self

# Worker functions travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(_self)
