"""Inference and conversion of JSON documents, and aggregations over paths."""
