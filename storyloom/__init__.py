"""storyloom: news and document corpus analytics as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# ship task functions inside the tasks, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
