"""Trajectory, point-cloud and recording analytics as Spark DataFrame operators."""
