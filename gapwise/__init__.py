"""gapwise: a PySpark-native analytics library for materials-screening data."""
