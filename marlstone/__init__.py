"""PySpark-native query engine for content collections and tables."""
