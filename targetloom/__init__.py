"""Evidence-integration analytics for target prioritisation, written as Spark DataFrame operators."""

__version__ = "0.1.0"
