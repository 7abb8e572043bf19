"""Credit-risk analytics as DataFrame-to-DataFrame operators for PySpark."""
