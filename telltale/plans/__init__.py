"""Plans of the condition-monitoring library."""
