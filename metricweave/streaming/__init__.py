"""Heartbeat checks on live feeds."""
