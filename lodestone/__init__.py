"""Lodestone: a Spark-native code-intelligence and corpus-analytics engine."""
