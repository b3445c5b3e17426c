"""Operators of the packet analytics engine."""
