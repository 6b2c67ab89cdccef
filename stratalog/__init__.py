"""Spark-native analytics over agent-session logs and linked notes."""
