"""A PySpark engine for building fronts: geometry, photo selection, grids, split grammars and their samples."""
