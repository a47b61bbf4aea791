"""Functions of the event-tape engine."""
