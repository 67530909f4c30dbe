"""Quillon: Spark-native clustering analytics."""
