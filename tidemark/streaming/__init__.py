"""Streaming of the event-tape engine."""
