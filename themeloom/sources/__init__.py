"""Scans, sinks, model bundles and the result registry."""
