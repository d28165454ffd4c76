"""quern: a PySpark-native engine for entity-year panels, text features and training-data preparation."""

__version__ = "0.1.0"
