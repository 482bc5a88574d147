"""Spark-native audit analytics: relational operators, leak-proof splits,
declarative model checks and a training-data subpackage."""

__version__ = "0.1.0"
