"""piisieve: PII candidate detection, verification and verifier comparison on Spark.

Every operator is a ``DataFrame -> DataFrame`` (or ``Column -> Column``) function whose
work is expressed with built-in Spark SQL expressions so Catalyst can push filters,
prune columns and keep the hot path inside whole-stage codegen.
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Functions that run in Python workers (scorer plug-in, deep JSON walk) are pickled by
    value, so executors need no copy of this package on their path."""
    try:
        import sys

        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # noqa: BLE001 - older cloudpickle: fall back to --py-files
        pass


_ship_by_value()
