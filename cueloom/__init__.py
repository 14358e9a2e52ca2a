"""Timed-text analytics as Spark DataFrame operators."""
