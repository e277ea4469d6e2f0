"""functions of the routing engine."""
