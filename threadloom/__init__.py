"""Text, co-occurrence and small-network analytics as lazy PySpark plans."""

__version__ = "0.1.0"
