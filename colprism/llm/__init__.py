"""Operators of a training-data pipeline: thirteen operators, their queries, and the stages of ``corpus_pipeline``.

Nothing outside this folder imports it.
"""

import os
import sys

from pyspark import cloudpickle

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
if _ROOT not in [os.path.abspath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]]:
    # Workers would not find this package by its name: functions travel with their code.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
