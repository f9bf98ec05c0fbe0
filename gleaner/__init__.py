"""gleaner: content extraction, cleaning and classification as Spark DataFrame operators."""

__version__ = "0.1.0"
