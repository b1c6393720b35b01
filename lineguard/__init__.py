"""Inspection-data quality and model-monitoring jobs for Spark."""

import sys

from pyspark import cloudpickle

# Ship the per-row helpers inside the serialized task, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
