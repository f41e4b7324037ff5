"""Streaming of the condition-monitoring library."""
