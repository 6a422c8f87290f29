"""habitnet: usage-graph analytics on PySpark.

Operators are plain functions from DataFrames to DataFrames (see
``habitnet.operators``); ``habitnet.plans.queries`` registers the queries
run over the driver tables and ``habitnet.plans.jobs`` chains the three
batch jobs end to end.
"""

__version__ = "0.1.0"
