"""Spark-native analytics for annotated documents and assistant logs."""
import sys

from pyspark import cloudpickle

# helpers used inside pandas UDFs travel with them, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
