"""Whole queries over tables, with their SQL."""
