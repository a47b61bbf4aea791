"""Sources of the event-tape engine."""
