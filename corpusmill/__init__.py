"""PySpark-native analytics engine for web-content corpora."""
