"""Spark-native analytics for runtime diagnostics evidence."""
