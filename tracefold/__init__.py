"""Trace-analytics lakehouse operators for PySpark."""
