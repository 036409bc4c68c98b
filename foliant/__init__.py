"""Foliant: tables with JSON columns on Spark, stored as typed nested columns."""
