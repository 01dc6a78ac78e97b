"""PySpark-native event-fusion analytics."""
