"""A PySpark engine for a wide-column query language and key-value commands."""
