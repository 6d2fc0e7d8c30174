"""Coded-document review analytics as lazy Spark DataFrame operators."""
