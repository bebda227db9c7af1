"""Operators for large training-data pipelines.

Functions that run inside Python workers travel with the job, so executors need
numpy, pyarrow and, for tokens, the tokenizers library, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
