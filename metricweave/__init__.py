"""Telemetry unification and feature pipelines as Spark DataFrame functions."""
