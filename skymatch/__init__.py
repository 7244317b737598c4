"""Nearest-neighbour inference over photometric catalogues, expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# functions travel to Python workers with their code, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
