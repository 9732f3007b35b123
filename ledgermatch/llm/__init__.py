"""Operators of a training-data pipeline, one module per operator.

Nothing else in the library imports this subpackage. Its functions are shipped
to Python workers by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
