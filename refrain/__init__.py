"""Finds stretches that repeat, approximately, across many integer streams - on Spark."""
