"""Computed-table analytics on Spark: formulas, error values, keyed merge, versions, documents, graphs."""
