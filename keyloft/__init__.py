"""keyloft: immutable, content-addressed datasets keyed by subset, on Spark DataFrames.

Functions that run on executors are sent by value, so executors need the third-party libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
