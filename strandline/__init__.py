"""Longitudinal event analytics written against the Spark DataFrame API."""
