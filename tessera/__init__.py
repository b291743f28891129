"""Volumetric cohort analytics on Spark."""
