"""Operators of a training-data pipeline: one module each, plus ``queries`` for the driver.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
