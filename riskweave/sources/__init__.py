"""Scans, sinks and stored state."""
