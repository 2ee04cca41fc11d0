"""gapwise: inter-event-time analytics expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# functions that run inside tasks travel with their code, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
