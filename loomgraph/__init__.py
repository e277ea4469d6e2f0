"""Capability-graph routing analytics, declared as Spark DataFrame plans."""
