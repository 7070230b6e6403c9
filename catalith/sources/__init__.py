"""Sources: the catalog's views, files, sidecars and selections."""

import sys

from pyspark import cloudpickle

#: Task functions travel by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
