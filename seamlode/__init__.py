"""Spark-native analytics and retrieval over provenance-carrying corpora."""
