"""A Spark-native engine for terrain and channel networks, with operators for training data."""
