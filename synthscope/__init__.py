"""Longitudinal tables and the synthetic tables that imitate them, as Spark jobs."""
