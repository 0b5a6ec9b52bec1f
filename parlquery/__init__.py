"""Search and analysis of assistant transcripts, expressed with Spark DataFrames."""

import os
import sys
from pathlib import Path

from pyspark import cloudpickle

_ROOT = str(Path(__file__).resolve().parent.parent)

# Python workers import this package by reference when it is on their path;
# otherwise its functions travel with the job.
if _ROOT not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
