"""Ephyra: a Spark-first engine for event-aligned session analytics."""
