"""Linear-referenced incident analytics as plain Spark DataFrame work."""

__version__ = "0.1.0"
