"""Composite entry points: scan, compare, monitor."""
