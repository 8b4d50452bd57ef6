"""Sensor-fleet analytics on PySpark: cleaning, alerting, interpolation, forecasting."""

import sys

from pyspark import cloudpickle

# Functions of this package travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
