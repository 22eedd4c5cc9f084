"""Fault-localization analytics and data pipelines on Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry this package's code with them, so that the
# workers need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
