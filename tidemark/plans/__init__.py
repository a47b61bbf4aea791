"""Plans of the event-tape engine."""
