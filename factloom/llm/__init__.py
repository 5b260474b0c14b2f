"""Training-data operators.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries only if the
subpackage is present.
"""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value: executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
