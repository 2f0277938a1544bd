"""Spend analytics as Spark DataFrame operators."""
