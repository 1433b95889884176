"""Line-evidence analytics on Spark: texts as ordered tables of lines, selections as line spans."""

import sys

from pyspark import cloudpickle

# Functions run by Python workers travel by value: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
