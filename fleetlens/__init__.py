"""Fleet telemetry analytics on Spark.

Operators are plain functions ``DataFrame -> DataFrame`` over landed telemetry tables keyed by
``(server, snapshot_ts)``.  Nothing here runs a command against a database: plans and remediation
texts are output columns.
"""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
