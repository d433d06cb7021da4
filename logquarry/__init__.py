"""Spark-native engine for log collection, investigation and masking."""
