"""Spark-native data integration: read, transform, sync, write, catalogue and run-log analytics.

Everything is a function from DataFrames to DataFrames; nothing here schedules work itself.
"""

import sys

from pyspark import cloudpickle

# Helpers that run inside tasks travel with the plan, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
