"""A PySpark engine for knowledge-base retrieval, its analytics, and training-data operators."""

import sys

from pyspark import cloudpickle

# Workers need not have the library installed: its functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
