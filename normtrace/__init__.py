"""normtrace: conformance analytics for process texts and event traces, as Spark plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Python functions that run in workers travel by value, so the workers need not have this
# package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
