"""Skew-safe relational, time-ordered and streaming operators for PySpark."""
