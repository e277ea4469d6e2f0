"""operators of the routing engine."""
