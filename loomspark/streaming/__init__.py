"""Operators with state over ordered input."""
