"""Operators for preparing text corpora. Nothing else in the library imports this subpackage.

Its functions travel to executors by value, so that clusters need no copy of the library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
