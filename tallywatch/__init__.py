"""Observability of machine-learning data and models as Spark jobs.

Every operator takes DataFrames and returns a DataFrame in long form, so results
can be filtered, joined and stored like any other table.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few pandas functions travel to the executors with the plan, so that nothing has
# to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
