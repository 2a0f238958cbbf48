"""Operators for preparing training text: each module is one operator.

Functions that run on executors are sent with the job, so executors need no copy of
this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
