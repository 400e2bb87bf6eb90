"""A Spark-native analytics engine for large file and media catalogues."""
