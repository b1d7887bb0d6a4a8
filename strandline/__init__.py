"""strandline: a Spark-first analytics engine for genomic association tables."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

__version__ = "0.1.0"

# Functions travel to the executors by value, so that a cluster needs no copy of the repository.
register_pickle_by_value(sys.modules[__name__])
