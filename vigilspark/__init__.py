"""User and entity behaviour analytics expressed as Spark DataFrame jobs."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions that run inside tasks travel with the job, so executors need pandas,
# numpy and pyarrow but no installed copy of this package.
register_pickle_by_value(sys.modules[__name__])
