"""Evidence tables from scholarly records and documents, on Spark."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Helpers used inside tasks travel with the job, so executors need no install.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
