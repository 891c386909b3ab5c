"""Training-data operators: secrets, quality, near copies, toxicity, shards, PII, language, leaks, BPE, WARC."""

import sys

from pyspark import cloudpickle

# Tasks get this package's code by value: workers need the libraries, not the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
