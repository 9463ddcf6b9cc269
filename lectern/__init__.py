"""lectern: a PySpark-native engine for time-stamped, positioned text."""
