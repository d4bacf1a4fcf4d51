"""inkloom: a PySpark-native engine for collections of web articles."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Python workers receive this package's functions by value, so a job does not
# depend on the package being installed on every executor.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
