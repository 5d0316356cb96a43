"""Tablewright: feature profiling, recommendation, transforms and evaluation as Spark jobs."""
