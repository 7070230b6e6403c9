"""Operators for preparing language-model training text at scale.

Nothing outside this package imports it; the entry module adds its queries only when it can be imported.
"""

import sys

from pyspark import cloudpickle

#: Task functions travel by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
