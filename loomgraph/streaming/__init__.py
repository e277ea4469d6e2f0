"""streaming of the routing engine."""
