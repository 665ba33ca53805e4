"""Answer-quality and reproducibility analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with the job: nothing needs to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
