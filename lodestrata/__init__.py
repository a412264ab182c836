"""lodestrata: a PySpark-native analytics engine for source code, history and text."""
