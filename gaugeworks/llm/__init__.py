"""Corpus operators for language-model training data. Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# Executors need no copy of the package: functions of these modules travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
