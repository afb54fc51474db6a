"""Weftline: relational synthetic data and data integrity, as Spark expressions."""
