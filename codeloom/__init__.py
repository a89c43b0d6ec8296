"""Code indexing and semantic search over source corpora, as Spark jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the executors by value, which therefore need no
# installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
