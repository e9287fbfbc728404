"""Table discovery over column embeddings, expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
