"""Spark-native archive, recall and corpus-preparation engine."""
