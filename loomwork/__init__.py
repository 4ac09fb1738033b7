"""PySpark-native analytics engine for curating, auditing and scoring record collections."""
