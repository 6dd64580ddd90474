"""Building-stock ensemble analytics expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions sent to tasks travel with their code, so executors need no install
cloudpickle.register_pickle_by_value(sys.modules[__name__])
