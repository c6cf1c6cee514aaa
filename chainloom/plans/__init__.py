"""Composite plans of the engine."""
