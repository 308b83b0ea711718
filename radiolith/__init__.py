"""Spark-native audit, preparation and evaluation of study-level imaging corpora."""

__version__ = "0.1.0"
