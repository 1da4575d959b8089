"""Operators for training-data corpora. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# workers get the code with the task, so they need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
