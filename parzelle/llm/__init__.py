"""Operators for large text corpora used to train language models.

Functions that run in Python workers travel with the job (by value), so a cluster
needs numpy and xxhash but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
