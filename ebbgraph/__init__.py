"""Temporal-edge security analytics as Spark DataFrame operators."""
