"""Operators for training-data pipelines. Nothing else in the library imports
this subpackage; ``registry`` holds its queries and their SQL."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel with their code, so that the package
# needn't be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
