"""Audit analytics as Spark jobs: DataFrame in, DataFrame out."""

import sys

from pyspark import cloudpickle

# The few Python helpers that run inside tasks travel with them, so executors need no copy
# of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
