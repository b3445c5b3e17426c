"""Plans of the packet analytics engine."""
