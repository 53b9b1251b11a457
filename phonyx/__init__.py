"""phonyx: speech-evaluation analytics expressed as Spark DataFrame transforms."""

import sys

from pyspark import cloudpickle

# Python workers get this package's functions with the task, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
