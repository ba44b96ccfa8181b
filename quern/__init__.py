"""A PySpark engine for building and curating training data: scans, schema
normalisation, validation, deduplication, sampling, fact graphs, verification
and scoring, all as DataFrame plans."""

import sys

from pyspark import cloudpickle

# The code of this package travels with each job, so executors need no installation of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
