"""docsift: exploring large document collections with PySpark DataFrames."""
import sys

from pyspark import cloudpickle

# Python functions sent to executors carry the package's code with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
