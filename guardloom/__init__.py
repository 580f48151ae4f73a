"""guardloom: a Spark-native engine for guardrail analytics.

Sub-packages: ``functions`` (column expressions), ``operators`` (DataFrame in,
DataFrame out), ``plans`` (policy to plan), ``sources`` (readers and sinks),
``streaming`` (keyed state).
"""

import sys

from pyspark import cloudpickle

# Python workers get this package's functions by value, so that executors need
# no copy of the repository on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
