"""Incremental forms of panel aggregates."""
