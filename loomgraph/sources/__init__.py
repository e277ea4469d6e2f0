"""sources of the routing engine."""
