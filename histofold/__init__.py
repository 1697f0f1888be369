"""histofold: commit-history maintenance analytics as Spark DataFrame jobs.

Layers:

* ``sources``   – table loading, the adapter that reads the driver tables as
                  commit histories, catalog / PaC-list / history / result
                  scans and the file sinks.
* ``functions`` – column-level helpers (file extension, URL, safe names,
                  distributed ordinals).
* ``operators`` – ``DataFrame -> DataFrame`` operators: classification,
                  per-repository metrics, inspection, co-change mining,
                  coverage.
* ``plans``     – the named query registry and the DuckDB oracle SQL.
"""

from histofold.session import get_spark, scratch_dir

__all__ = ["get_spark", "scratch_dir"]
