"""axonlake: a PySpark-native analytics engine for stimulus-driven recordings.

Functions sent to Python workers are pickled by value, so that executors need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
