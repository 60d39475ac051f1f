"""ledgershield: Spark jobs for privacy-controlled AI traffic and finance operations data."""

import sys

from pyspark.cloudpickle.cloudpickle import register_pickle_by_value

__version__ = "0.1.0"

# Python functions of this package travel with the job: executors need no copy of the package.
register_pickle_by_value(sys.modules[__name__])
