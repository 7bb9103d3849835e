"""PySpark-native event-study and signal-validation engine."""
