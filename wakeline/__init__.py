"""Trajectory screening and corpus preparation on Spark."""
