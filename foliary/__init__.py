"""A Spark-native engine for document templates, record rules, layout and corpus work.

Functions that run in Python workers are shipped by value, so executors need no
copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
