"""Agronomic trial analytics on Spark."""
