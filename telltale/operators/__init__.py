"""Operators of the condition-monitoring library."""
