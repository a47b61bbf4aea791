"""Operators of the event-tape engine."""
