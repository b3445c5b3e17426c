"""Streaming of the packet analytics engine."""
