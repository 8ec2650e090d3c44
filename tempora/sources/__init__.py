"""Schemas, CSV scans, table sinks, and the tables derived from the test data."""
