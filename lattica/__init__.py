"""A PySpark-native engine for multi-dimensional points: boxes, neighbours, learned grids and trees."""
