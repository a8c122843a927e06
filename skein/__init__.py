"""skein: corpus preparation, evaluation and training-data operators on PySpark.

The package's own functions travel to Python workers by value, so a cluster
needs nothing of this package installed on its executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
