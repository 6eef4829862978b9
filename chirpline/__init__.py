"""Social-post sentiment and signal jobs for Spark."""

import sys

from pyspark import cloudpickle

# The functions that run in Python workers travel with their tasks, so no node needs this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
