"""A PySpark-native engine for experiment data and training-data preparation."""
