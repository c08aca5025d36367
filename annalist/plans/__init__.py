"""Helpers that shape physical execution: staging, skew, table access."""
