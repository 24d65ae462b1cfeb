"""Versioned rules and the agents that must follow them, as Spark plans."""
