"""Change-data lakehouse operators for PySpark."""
