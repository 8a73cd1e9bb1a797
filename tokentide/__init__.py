"""Spark-native analytics over the JSONL session logs of coding agents."""
