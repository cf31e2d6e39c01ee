"""Operators for preparing large training corpora.

Functions that run in Python workers travel with the job by value, so executors need no copy of
this package on their own path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
