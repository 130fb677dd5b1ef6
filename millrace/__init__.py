"""Millrace: a Spark-native engine that turns raw text into training datasets."""
