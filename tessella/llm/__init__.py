"""Operators for large training corpora. Nothing outside this folder imports it, apart from the query registry, which does so only when the folder is there."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors as code, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
