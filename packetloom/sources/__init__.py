"""Sources of the packet analytics engine."""
