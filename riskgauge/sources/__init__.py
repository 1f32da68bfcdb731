"""Scans, sinks, manifests and integrity checks."""
