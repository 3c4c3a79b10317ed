"""Payload scans, stored tables and sinks."""
