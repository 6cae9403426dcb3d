"""Operators of a training-data pipeline.

Task code of this package travels to the executors by value, so a cluster needs
no copy of the repository on its machines.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
