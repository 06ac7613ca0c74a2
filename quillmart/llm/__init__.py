"""Operators for cleaning and mixing a text corpus, and for searching its vectors.

Nothing outside this folder imports it. Functions that run inside Python workers are pickled by value,
so that executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
