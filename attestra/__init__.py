"""Evidence analytics as PySpark jobs.

Subpackages: ``functions`` (Column expressions), ``sources`` (readers and sinks),
``operators`` (DataFrame in, DataFrame out), ``plans`` (multi-operator jobs) and
``streaming`` (trace jobs).
"""

import sys

from pyspark import cloudpickle

# Helpers used inside Arrow batches travel to executors with the task, so a cluster
# needs no separate install of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
