"""Functions of the packet analytics engine."""
