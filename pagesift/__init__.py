"""pagesift — turn stored web pages and documents into clean, deduplicated,
enriched record tables with Spark DataFrames.

Every operator is a function from DataFrames/Columns to DataFrames/Columns
built on public PySpark APIs. See README.md for the module map.
"""

import sys as _sys

__version__ = "0.1.0"

# The few Python UDFs (exact HTML parser, URL-join fallback, strict JSON
# check, batch inference) are shipped to the Python workers by value, so the
# workers do not need this package on their import path (executors of a
# cluster, or a driver started from another working directory).
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older pickler: rely on the import path
    pass
