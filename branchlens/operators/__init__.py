"""DataFrame -> DataFrame operators (aggregations, windows, models)."""

import sys

from pyspark import cloudpickle

# functions sent to workers carry this subpackage's code, so workers need not import it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
