"""ledgergraph — ontology-driven financial analytics as Spark DataFrame jobs.

Every operator is a plain ``DataFrame -> DataFrame`` function; Catalyst plans
the joins and aggregations.  Sub-packages:

* ``sources``   — driver tables, fixture views, the account ontology, readers/writers
* ``functions`` — column-level scalar helpers (``Column -> Column``)
* ``operators`` — graph, evaluation, quality, series, corpus, text, sequence, metrics, dialog
* ``plans``     — the registry of named queries and their SQL oracles
* ``streaming`` — Structured Streaming jobs
"""

__version__ = "0.1.0"

# Python functions shipped to executors (applyInPandas / applyInPandasWithState
# bodies) are pickled by value, so workers need no installed copy of this package.
try:  # pragma: no cover - depends on the bundled cloudpickle
    import sys as _sys

    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
