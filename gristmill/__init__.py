"""A relational and mining engine on PySpark's DataFrame and SQL APIs."""
