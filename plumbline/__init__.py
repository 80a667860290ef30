"""Evaluation, drift and attribution analytics as Spark DataFrame operators."""
