"""Spark-first analytics for tool-calling dialogues."""
