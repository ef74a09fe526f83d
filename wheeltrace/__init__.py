"""Driving-recording analytics expressed as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Task functions travel with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
