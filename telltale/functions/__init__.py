"""Functions of the condition-monitoring library."""
