"""Training-data operators: mixing, filtering, near-duplicate and language-model components.

Nothing outside this folder imports it; the folder can be removed and the
rest of the library keeps working.
"""

import sys

from pyspark import cloudpickle

# Workers need not have the library installed: its functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
