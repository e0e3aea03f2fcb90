"""quarry: data profiling, feature engineering and model comparison on Spark."""

import sys as _sys

# The pandas functions (kNN distances, isolation-forest growth and scoring) are
# defined in this package. Pickling the package by value lets Python workers run
# them without having the package installed or on their path.
try:  # pragma: no cover - depends on the pyspark build
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
