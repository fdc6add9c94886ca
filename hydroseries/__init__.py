"""PySpark-native analytics over satellite water-surface rasters and lake outlines."""
