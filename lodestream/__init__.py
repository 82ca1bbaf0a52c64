"""A PySpark-native engine for SQL analytics and SQL data-flow analysis."""
