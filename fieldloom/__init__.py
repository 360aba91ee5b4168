"""Fieldloom: infrastructure-demand and text analytics declared on Spark DataFrames.

The package ships its Python functions to executors by value, so a cluster
needs only PySpark, pandas, pyarrow and numpy, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
