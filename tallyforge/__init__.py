"""tallyforge: a Spark-native engine for sports statistics and corpus work."""

__version__ = "0.1.0"
