"""Functions that run inside tasks travel with the job.

Executors need no installed copy of this package: the few modules whose
functions run in Python workers are pickled by value.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def by_value(*modules: str) -> None:
    for name in modules:
        cloudpickle.register_pickle_by_value(sys.modules[name])
