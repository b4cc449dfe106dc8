"""limnos — water-quality analytics on Spark.

Column functions (``limnos.functions``) turn raw cells and probe readings into
physical values and fuzzy class memberships; operators (``limnos.operators``)
are ``DataFrame -> DataFrame`` building blocks (cleaning, splitting, scaling,
models, fuzzy matrices); ``limnos.sources`` reads messy delimited files and
sensor logs; ``limnos.streaming`` runs the same column functions on streams;
``limnos.plans`` wires them into the lake-training / pond-scoring / surrogate
pipelines and the query catalogue.
"""

import sys as _sys

from limnos.session import get_session, shared_dir

# Python-side helpers (the pandas functions of the kNN join) are shipped to
# the workers together with their closures, so executors need no installed
# copy of this package.
try:
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

__all__ = ["get_session", "shared_dir"]
