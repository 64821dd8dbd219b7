"""Constraints as Spark columns."""
