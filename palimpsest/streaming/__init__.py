"""Streaming twins of the audit queries."""
