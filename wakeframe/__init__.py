"""Spark-native analytics for flow-field maps, sensor series, vortex tracks and contours."""

import sys

from pyspark import cloudpickle

# Ship the functions that run in tasks by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
