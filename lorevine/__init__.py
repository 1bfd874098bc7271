"""Lorevine: a Spark-native text retrieval and evaluation engine."""
