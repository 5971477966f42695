"""PySpark-native medallion pipeline for flight on-time performance data."""
