"""Event studies on price bars with PySpark."""
