"""A PySpark-native integrity-constraint engine for document collections and tables."""
