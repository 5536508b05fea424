"""ampliq: amplicon and DNA-barcode analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Arrow functions defined here travel to the executors by value, so a cluster
# needs no copy of this package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
