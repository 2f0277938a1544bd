"""Operators of a training-data pipeline over text tables.

Functions that run inside Python workers are shipped by value, so workers need no copy of this
source tree.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
