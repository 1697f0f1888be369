"""Operators for large training-data pipelines (see README.md in this folder).

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its
queries when it can be imported.
"""
