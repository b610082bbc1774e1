"""Spark-native analytics: rolling correlation networks, inference, filings text and training-data operators."""
