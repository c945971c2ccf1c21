"""Document retrieval and corpus processing expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
