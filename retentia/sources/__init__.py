"""Readers, sinks and the proxy tables built from the driver's data."""
