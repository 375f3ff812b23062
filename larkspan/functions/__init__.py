"""Scalar column functions: text, periods, scores."""
