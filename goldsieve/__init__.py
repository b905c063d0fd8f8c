"""Spark-native curation of evaluation sets from model interaction logs."""

import sys

from pyspark import cloudpickle

from goldsieve.session import build_session

# Functions sent to executors travel with the job, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session"]
