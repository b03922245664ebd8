"""Catalog enrichment and training-data operators on Spark."""

import sys

from pyspark import cloudpickle

# functions for Python workers carry their code: executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
