"""cadenza: a PySpark-native analytics engine for listening data."""
