"""Spark-native analytics over labelled documents, events and entities."""
