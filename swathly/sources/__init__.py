"""Readers and writers of the sensor's files."""
