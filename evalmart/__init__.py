"""Evaluation-log analytics as Spark DataFrame operators."""
