"""Training-data operators. Nothing else in the library imports this folder.

Functions of this package are shipped to the executors by value, so a worker
needs numpy / pyarrow but no copy of this repository on its path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
