"""Sources of the condition-monitoring library."""
