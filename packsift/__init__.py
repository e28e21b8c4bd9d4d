"""Corpus-scale scanning of packaged text files as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# The few Python functions that run in tasks travel with the job, so workers need
# not have the package installed or on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
