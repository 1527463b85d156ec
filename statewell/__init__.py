"""statewell: state-transition analytics as Spark DataFrame operators.

Every operator takes and returns DataFrames and accepts group keys, so that
many cohorts, layers, components or replicates run in one job.
"""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code with them, so a cluster needs no
# copy of this package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
