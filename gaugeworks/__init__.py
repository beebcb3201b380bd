"""Measurement analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Executors need no copy of the package: functions of its modules travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
