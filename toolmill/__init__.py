"""Tool-catalog analytics as PySpark jobs: ingest, extraction, quality rules,
clustering, retrieval, evaluation metrics and usage statistics."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

__version__ = "0.1.0"

# The few Arrow functions travel to executors with their code, so that workers
# need no installed copy of this package.
register_pickle_by_value(sys.modules[__name__])
