"""cairn: content-addressed deduplication analytics on PySpark."""

__version__ = "0.1.0"
