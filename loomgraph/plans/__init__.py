"""plans of the routing engine."""
