"""lodestack: a PySpark-native analytics engine for source-cited records and training text."""
