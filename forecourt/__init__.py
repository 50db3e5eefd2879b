"""Analytics over messy vehicle listings: bronze batches, checked and merged silver tables, gold statistics."""

import sys

from pyspark import cloudpickle

# Functions go to the executors with their code, so that those need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
