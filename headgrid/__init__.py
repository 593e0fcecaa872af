"""Versioned headcount and FTE planning tables as PySpark DataFrame operators."""
