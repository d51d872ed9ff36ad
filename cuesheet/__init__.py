"""Narration scripts and subtitle timing as Spark DataFrame operators."""
