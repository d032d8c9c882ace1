"""Keepsake: an archive index made of plain Spark DataFrames."""

import sys

from pyspark import cloudpickle

from .session import configure, shared_dir

__all__ = ["configure", "shared_dir"]

# Python stages travel to the executors by value: nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
