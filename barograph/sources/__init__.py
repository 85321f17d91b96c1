"""Readers, sinks and the mapping from user tables to the series model."""
