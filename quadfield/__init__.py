"""Spark-native analytics for two-dimensional spectral-element field data.

Every element of a mesh is one row; nodal coordinates and field values are
``ARRAY<DOUBLE>`` columns of length ``n * n`` in row-major order
(``p = j * n + i``, ``i`` fastest).  All operators take and return DataFrames
(or Columns) and are lazy, except where a docstring says otherwise.
"""
