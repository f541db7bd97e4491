"""Statistics, drift detection, regression and forecasting as Spark jobs."""

import sys

from pyspark import cloudpickle

# The small functions behind the pandas UDFs travel with the tasks, so executors
# need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
