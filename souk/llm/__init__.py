"""Operators of a training-data pipeline: DataFrame in, DataFrame out.

Nothing outside this subpackage imports it; ``queries.py`` registers one query
per operator and ``corpus_pipeline.py`` chains five of them.
"""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with their code, so executors
# need no copy of this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
