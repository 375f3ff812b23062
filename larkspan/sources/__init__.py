"""Readers: reviews from CSV, nested JSON lines, and an adapter from star-schema tables."""
