"""Spark-first engine that refines daily gridded fields."""
