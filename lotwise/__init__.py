"""Private linear models on Spark: preparation, training, evaluation and a privacy ledger.

Training tables carry ``row_id``, ``y`` and either a dense ``features ARRAY<DOUBLE>`` or the
sparse pair ``indices ARRAY<INT>, values ARRAY<DOUBLE>``.  Models are vectors of one record's
width, so what travels with a task is never larger than one row times the number of runs.
"""

import sys

from pyspark import cloudpickle

# Executors need no copy of the package: what a task uses is shipped with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
