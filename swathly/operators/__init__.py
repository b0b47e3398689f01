"""Relational operators of the sensor pipeline."""
