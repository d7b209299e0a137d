"""vitalgrain: clinical and claims analytics expressed as Spark plans."""

import sys

from pyspark import cloudpickle

# Workers receive the package's functions by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
