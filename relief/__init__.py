"""relief: tiled elevation rasters as Spark DataFrames.

A layer is either *tiles* ``(col, row, data ARRAY<DOUBLE>)`` -- the stored,
packed form -- or *cells* ``(gx, gy, value)`` -- the exploded form whose global
grid index is the mosaic.  NODATA is SQL NULL everywhere.  Every operator takes
DataFrames and returns DataFrames and runs no action (the region labelling
rounds in :mod:`relief.operators.vectorize` are the one documented exception).
"""

from relief.schema import Grid

__all__ = ["Grid"]
