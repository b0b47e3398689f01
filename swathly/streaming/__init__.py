"""Structured Streaming front ends of operators that make sense on live data."""
