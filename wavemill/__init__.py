"""Spark-native analytics over windowed biosignals, alarms and model predictions."""
