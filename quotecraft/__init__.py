"""quotecraft: end-of-day market analytics on PySpark.

Every operator is a function DataFrame -> DataFrame built from Spark's own
joins, windows and aggregates.  Sub-packages:

- ``sources``    loading, staging, tables, exports and ordered refresh
- ``operators``  calendar, quality, relational, aggregates, prices,
                 returns, performance and portfolio operators
- ``functions``  Column-level helpers (float32 division, moments, ...)
- ``plans``      the three end-to-end studies composed from operators
- ``streaming``  incremental daily refresh with Structured Streaming
- ``queries``    registry of checked queries and their SQL oracles
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python steps travel to the workers with their code: a worker needs pandas and
# numpy, but not this package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
