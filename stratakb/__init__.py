"""stratakb: anchored-knowledge analytics as PySpark DataFrame operators.

Functions of this package that run in Python workers are pickled by value, so
a cluster needs nothing but the driver's copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
