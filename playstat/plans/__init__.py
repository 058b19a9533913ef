"""Composite analyses and the registry of named queries."""
