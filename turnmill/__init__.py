"""turnmill: Spark operators that build and evaluate a multi-speaker dialogue corpus."""

import sys

from pyspark import cloudpickle

# Ship the package's own functions with each Python task, so that executors need no install of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
