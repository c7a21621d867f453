"""Catalog harvesting on Spark: rules in, clean catalog tables out."""

import sys

from pyspark import cloudpickle

# Python workers need not have the package: its few functions that run there
# travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
