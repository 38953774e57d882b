"""quarry: a governed analytics engine expressed in PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors need no installation of the package: its functions travel with the tasks that call them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
