"""Evidence analytics and corpus preparation as declarative PySpark plans.

Functions that run on executors travel by value, so only the driver needs this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
