"""recordloom: record-intake analytics as declarative PySpark plans."""
