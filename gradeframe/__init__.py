"""Spark-first engine for grading nested, model-emitted records at scale."""
