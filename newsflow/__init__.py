"""Newsflow: news-pipeline analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# the few Python helpers travel with the tasks, so executors need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
