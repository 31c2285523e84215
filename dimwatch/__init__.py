"""A PySpark-native engine for finding dips and brightenings in light curves, with a training-data subpackage."""
