"""lexforge: a Spark-native engine for versioned, hierarchical document corpora."""

import sys

from pyspark import cloudpickle

# Python stages carry their code with them, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
