"""glyphflow: text-recognition analytics as Spark DataFrame transformations."""

import sys

from pyspark import cloudpickle

from glyphflow.settings import Settings

# Functions that run in Python workers travel with the task, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Settings"]
