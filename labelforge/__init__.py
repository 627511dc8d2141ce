"""Label-compliance analytics on PySpark."""
