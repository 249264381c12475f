"""A Spark-native engine for cross-sectional factor research."""
