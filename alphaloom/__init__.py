"""A Spark-native engine for cross-sectional factor research and training-data preparation."""
